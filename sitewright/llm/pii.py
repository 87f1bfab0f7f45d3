"""Information-theoretic sanitisation of personal data (operator 7), in DataFrame expressions only.

Protected entities are e-mail addresses, IP addresses, payment cards and phone numbers found by fixed patterns. Terms
in a window around an entity are candidates to reveal it. Over the whole corpus,

    IC(e)     = log2(N / df(e))                     what knowing the entity is worth
    PMI(e, t) = log2(N * df(e, t) / (df(e) * df(t)))   what the term tells about it

with document frequencies df. A term whose PMI reaches `remove` x IC discloses the entity and is removed; one that
reaches `generalise` x IC is generalised to its kind of word, wherever it stands in any text. Pairs must be seen in
`contexts` different windows, or in all windows of an entity that has fewer. Windows that are equal count once. df(t) is counted for candidate terms only, in one
more pass over the texts that runs if there are candidates; terms that stand beside too many entities to reach the
threshold at any df(t) are no candidates.

Spans come from pairs of regexp_extract_all and split: they see the same matches, and the lengths of the pieces give
positions in code points. Running sums go by blocks of about the root of their number, and texts are read at a place by
blocks of code points, so the work on one text of n matches grows with n to the power of 1.5 at most. The patterns are written so that Java's matcher needs neither backtracking over long runs nor
recursion: a run's first character (or the end of the last match) is the only place where a match can begin.

Nulls: a null text is empty and has no spans. Repeated rows give repeated results; each counts as a document. An empty
table gives an empty result. Where changes of a sanitised text overlap, the first one's text stands for all they cover.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.functions.arrays import greater, let, running
from sitewright.llm.common import text_of, written

KINDS = ("email", "ip", "card", "phone", "term")
TERM = KINDS.index("term")
WINDOW = 60
BLOCK = 1024
CONTEXTS = 3
REMOVE, GENERALISE = 0.9, 0.7
LABELS = ("<EMAIL>", "<IP>", "<CARD>", "<PHONE>")
REMOVED, GENERAL_NAME, GENERAL_WORD = "", "<NAME>", "<WORD>"
# The same matches as the plain patterns beside them.
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",  # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",  # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    r"[0-9](?:[\x20-]?[0-9]){12,}+",  # [0-9]([\x20-]?[0-9])+, where 13 digits are needed
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
OCTETS = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
WORD = r"(?<![\p{L}\p{N}])\p{L}{3,}+(?![\p{L}\p{N}])"
SPAN = "array<struct<kind:int,start:bigint,end:bigint,value:string>>"
TERM_TYPE = "struct<start:bigint,end:bigint,value:string,level:string>"


def matches(text: Column, pattern: str, kind: int, offset: Column | None = None, wanted: Callable[[Column], Column] | None = None) -> Column:
    """Spans (kind, start, end, value) of all matches, leftmost and not overlapping; of those whose value is wanted, if asked."""
    offset = F.lit(0).cast("bigint") if offset is None else offset.cast("bigint")
    none = F.array().cast(SPAN)
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def spans(x: Column, ends: Column) -> Column:
        def span(value: Column, k: Column) -> Column:
            end = offset + F.get(ends, k)
            whole = F.struct(F.lit(kind).alias("kind"), (end - F.char_length(value)).cast("bigint").alias("start"), end.cast("bigint").alias("end"), value.alias("value"))
            return whole if wanted is None else F.when(wanted(value), whole)

        found = F.transform(x.found, span)
        return found if wanted is None else F.filter(found, lambda y: y.isNotNull())

    sizes = lambda x: F.transform(x.found, lambda value, k: (F.char_length(F.get(x.gaps, k)) + F.char_length(value)).cast("bigint"))
    return let(both, lambda x: F.when(F.size(x.found) > 0, let(running(sizes(x)), lambda ends: spans(x, ends))).otherwise(none))


def blocks_of(text: Column) -> Column:
    """The text in blocks of BLOCK code points, for `part`."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))


def part(blocks: Column, start: Column, size: Column) -> Column:
    """Code points start to start + size of a text in blocks; less where it ends before."""
    first = F.floor(start / BLOCK).cast("int")
    last = F.floor((start + F.greatest(size, F.lit(1)) - 1) / BLOCK).cast("int")
    return F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), (start - first * BLOCK + 1).cast("int"), size.cast("int"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def entity_spans(text: Column) -> Column:
    """Base spans by kind, then start. Patterns run only where a text holds what each can't do without."""
    empty = F.array().cast(SPAN)
    email = F.when(F.contains(text, F.lit("@")), matches(text, PATTERNS[0], 0)).otherwise(empty)
    numbers = text.rlike("[0-9][0-9. -]{5}")
    ip = F.when(numbers, F.filter(matches(text, PATTERNS[1], 1), lambda s: s.value.rlike(OCTETS))).otherwise(empty)
    card = F.when(numbers, F.filter(matches(text, PATTERNS[2], 2), lambda s: F.length(digits(s.value)).between(13, 19) & F.call_function("luhn_check", digits(s.value)))).otherwise(empty)
    phone = F.when(F.contains(text, F.lit("+")), F.filter(matches(text, PATTERNS[3], 3), lambda s: F.length(digits(s.value)).between(9, 15))).otherwise(empty)
    return F.concat(email, ip, card, phone)


def window_terms(blocks: Column, span: Column) -> Column:
    """Words of three or more letters within WINDOW code points of a span; words cut by the window's edge are left out."""
    before_at = F.greatest(span.start - WINDOW, F.lit(0)).cast("bigint")
    before, after = part(blocks, before_at, span.start - before_at), part(blocks, span.end, F.lit(WINDOW))
    left = F.filter(matches(before, WORD, TERM, before_at), lambda t: (t.start > before_at) | (before_at == 0))
    right = let(after, lambda after: F.filter(matches(after, WORD, TERM, span.end), lambda t: (t.end < span.end + F.char_length(after)) | (F.char_length(after) < WINDOW)))
    return F.concat(left, right)


def joined(spans: str) -> Column:
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(element_at(array({kinds}), x.kind + 1), ':', x.start, ':', x.end)), ',')")


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", contexts: int = CONTEXTS, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """(doc_id, row, base, terms): base spans and, for each row, the spans of disclosing terms in its whole text with their level.

    row numbers the rows of the written scan; terms are (start, end, value, level), level 'remove' or 'generalise'.
    """
    return _scanned(docs, text, key, contexts, remove, generalise).select("doc_id", "row", "base", "terms")


def _scanned(docs: DataFrame, text: str, key: str, contexts: int = CONTEXTS, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """What `scan` gives, with the text t."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("t"))
    found = rows.select("doc_id", "t", entity_spans(F.col("t")).alias("base"))
    around = lambda blocks: F.transform("base", lambda s: F.struct(s.kind.alias("kind"), F.lower(s.value).alias("value"), window_terms(blocks, s).alias("words")))
    near = F.when(F.size("base") > 0, let(blocks_of(F.col("t")), around)).otherwise(F.array())
    base = written(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "t", "base", near.alias("near")), "entities")

    seen = base.where(F.size("near") > 0).select("row", F.explode("near").alias("n"))
    seen = seen.select("row", F.concat_ws(":", F.col("n.kind").cast("string"), "n.value").alias("entity"), F.xxhash64(F.transform("n.words", lambda w: w.value)).alias("context"), "n.words")
    pairs = seen.select("row", "entity", "context", F.explode("words").alias("w")).select("row", "entity", "context", F.lower("w.value").alias("term"))
    total = float(base.count())
    of_entity = seen.groupBy("entity").agg(F.count_distinct("row").alias("of_entity"), F.count_distinct("context").alias("windows"))
    at_least = pairs.groupBy("term").agg(F.count_distinct("row").alias("at_least"))
    grouped = pairs.groupBy("entity", "term", "context").agg(F.count_distinct("row").alias("rows")).groupBy("entity", "term").agg(F.sum("rows").alias("both"), F.count("*").alias("contexts"))
    worth = F.log2(F.lit(total) / F.col("of_entity"))
    told = lambda of_term: F.log2(F.lit(total) * F.col("both") / (F.col("of_entity") * F.col(of_term)))
    # df(t) is no less than the rows that have t beside any entity: what can't reach the threshold even then is out.
    candidates = written(grouped.join(of_entity, "entity").join(at_least, "term").where((F.col("contexts") >= F.least(F.lit(contexts), "windows")) & (worth > 0) & (told("at_least") >= generalise * worth)), "candidates")
    if candidates.isEmpty():
        flagged = candidates.select("entity", "term", F.lit(None).cast("string").alias("level"))
    else:
        words = rows.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(WORD), F.lit(0)))).alias("term"))
        of_term = words.groupBy("term").agg(F.count("*").alias("counted"))  # each task adds up its words before they meet a candidate
        rated = candidates.join(of_term, "term").withColumn("of_term", F.greatest("counted", "at_least"))
        flagged = rated.select("entity", "term", F.when(told("of_term") >= remove * worth, "remove").when(told("of_term") >= generalise * worth, "generalise").alias("level")).where("level is not null")
    levels = written(flagged.groupBy("term").agg(F.max("level").alias("level")), "flagged")
    # A text is searched for places only if it holds a flagged term.
    held = base.select("row", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), F.lower))).alias("term")).join(levels, "term")
    held = held.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "level"))).alias("held"))
    level = lambda value: F.element_at("held", F.lower(value))
    spans = matches(F.col("t"), WORD, TERM, wanted=lambda value: level(value).isNotNull())
    terms = F.transform(spans, lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), x.value.alias("value"), level(x.value).alias("level")))
    by_row = base.select("row", "t").join(held, "row").select("row", terms.alias("terms"))
    none = F.array().cast(f"array<{TERM_TYPE}>")
    return base.select("row", "doc_id", "t", "base").join(by_row, "row", "left").select("doc_id", "row", "t", "base", F.coalesce("terms", none).alias("terms"))


def free_terms(base: str = "base", terms: str = "terms") -> Column:
    """The terms that overlap no base span, by start. In the order of base spans' starts and terms' ends, a term is free if no base span so far ends behind its start."""
    begun = F.transform(base, lambda b: F.struct(b.start.alias("at"), F.lit(1).alias("later"), b.end.alias("reach"), F.lit(None).cast(TERM_TYPE).alias("term")))
    ended = F.transform(terms, lambda t: F.struct(t.end.alias("at"), F.lit(0).alias("later"), F.lit(0).cast("bigint").alias("reach"), t.alias("term")))
    reach = lambda events: running(F.transform(events, lambda e: e.reach), greater)
    free = lambda events, reach: F.transform(events, lambda e, k: F.when(F.get(reach, k) <= e.term.start, e.term))
    found = let(F.array_sort(F.concat(begun, ended)), lambda events: F.filter(let(reach(events), lambda r: free(events, r)), lambda t: t.isNotNull()))
    return F.when((F.size(base) == 0) | (F.size(terms) == 0), F.col(terms)).otherwise(found)


def all_spans(base: str = "base", terms: str = "terms") -> Column:
    """Base spans in their order, then the terms that overlap none of them, by start."""
    return F.concat(F.col(base), F.transform(free_terms(base, terms), lambda t: F.struct(F.lit(TERM).alias("kind"), t.start.alias("start"), t.end.alias("end"), t.value.alias("value"))))


def sanitised(docs: DataFrame, text: str = "text", key: str = "doc_id", **options: float) -> DataFrame:
    """(doc_id, text): entities become their kind, disclosing terms go or become <NAME> (capitalised) or <WORD>."""
    found = _scanned(docs, text, key, **options)
    names = F.array(*map(F.lit, LABELS))
    label = F.transform("base", lambda b: F.struct(b.start.alias("start"), b.end.alias("end"), F.get(names, b.kind).alias("put")))
    put = lambda t: F.when(t.level == "remove", REMOVED).when(t.value.rlike(r"^[\p{Lu}]"), GENERAL_NAME).otherwise(GENERAL_WORD)
    term = F.transform(free_terms(), lambda t: F.struct(t.start.alias("start"), t.end.alias("end"), put(t).alias("put")))
    changed = found.select("doc_id", "t", F.array_sort(F.concat(label, term)).alias("changes"))

    def rewritten(blocks: Column, reach: Column) -> Column:
        before = lambda k: F.coalesce(F.when(k > 0, F.get(reach, k - 1)), F.lit(0))
        kept = F.transform("changes", lambda c, k: F.when(c.start >= before(k), F.concat(part(blocks, before(k), c.start - before(k)), c.put)).otherwise(""))
        end = F.element_at(reach, F.lit(-1))
        return F.concat(F.array_join(kept, ""), part(blocks, end, F.char_length("t") - end))

    done = let(blocks_of(F.col("t")), lambda blocks: let(running(F.transform("changes", lambda c: c.end), greater), lambda reach: rewritten(blocks, reach)))
    return changed.select("doc_id", F.when(F.size("changes") > 0, done).otherwise(F.col("t")).alias("text"))
