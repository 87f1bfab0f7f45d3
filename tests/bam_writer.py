"""A small writer of BAM files and their index, for tests."""

import struct
import zlib

CIGAR = "MIDNSHP=X"
SEQ = "=ACMGRSVTWYHKDBN"


def block(data):
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(contigs, contig, start, mapq, flag, cigar, seq, qual, tags):
    tid = -1 if contig is None else [c for c, _ in contigs].index(contig)
    ops = [(int(n), CIGAR.index(o)) for n, o in cigar]
    codes = [SEQ.index(c) for c in seq] + [0] * (len(seq) % 2)
    body = struct.pack("<iiBBHHHiiii", tid, start, 2, mapq, 0, len(ops), flag, len(seq), -1, -1, 0) + b"r\0"
    body += b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + (b"\xff" * len(seq) if qual is None else bytes(ord(q) - 33 for q in qual))
    for name, kind, value in tags:
        body += name.encode() + kind.encode()
        body += value.encode() + b"\0" if kind == "Z" else struct.pack("<i", value) if kind == "i" else b"C" + struct.pack("<I", len(value)) + value
    return struct.pack("<i", len(body)) + body


def bin_of(start, stop):
    """The smallest bin of the index that holds a range."""
    for first, shift in ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26)):
        if start >> shift == (stop - 1) >> shift:
            return first + (start >> shift)
    return 0


def index_of(contigs, reads, places):
    """BAI of records (in order) between virtual offsets."""
    out = b"BAI\1" + struct.pack("<i", len(contigs))
    for name, length in contigs:
        bins, windows = {}, [0] * ((length >> 14) + 1)
        for read, begin, end in zip(reads, places, places[1:]):
            if read[0] != name:
                continue
            start = read[1]
            stop = start + max(1, sum(int(n) for n, op in read[4] if op in "MDN=X"))
            bins.setdefault(bin_of(start, stop), []).append((begin, end))
            for w in range(start >> 14, ((stop - 1) >> 14) + 1):
                windows[w] = windows[w] or begin
        out += struct.pack("<i", len(bins) + 1) + b"".join(struct.pack("<Ii", b, len(c)) + b"".join(struct.pack("<QQ", *x) for x in c) for b, c in bins.items())
        out += struct.pack("<IiQQQQ", 37450, 2, 0, 0, 0, 0)
        out += struct.pack("<i", len(windows)) + struct.pack(f"<{len(windows)}Q", *windows)
    return out


def write_bam(path, contigs, reads, block_size=64, index=False):
    """Blocks of `block_size` bytes, so that records cross them."""
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(contigs)) + b"".join(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in contigs)
    parts = [record(contigs, *r) for r in reads]
    data = head + b"".join(parts)
    out, places = [], {}
    size = 0
    for at in range(0, len(data), block_size):
        places[at] = size
        out.append(block(data[at : at + block_size]))
        size += len(out[-1])
    with open(path, "wb") as file:
        file.write(b"".join(out) + block(b""))
    if index:
        offsets, at = [], len(head)
        for p in [*parts, b""]:
            whole = at // block_size * block_size
            offsets.append(places.get(whole, size) << 16 | at % block_size)
            at += len(p)
        with open(f"{path}.bai", "wb") as file:
            file.write(index_of(contigs, reads, offsets))
