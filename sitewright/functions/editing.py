"""The six kinds of RNA editing and what they mean on either strand."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewright.errors import InvalidInput

COMPLEMENT = {"A": "T", "T": "A", "G": "C", "C": "G"}


class EditingType(Enum):
    AG = "ag"
    AC = "ac"
    AT = "at"
    CA = "ca"
    CG = "cg"
    CT = "ct"

    @classmethod
    def parse(cls, text: str) -> EditingType:
        try:
            return cls(text.lower())
        except ValueError:
            raise InvalidInput(f"editing type {text!r}; known are {', '.join(e.value for e in cls)}") from None

    def __str__(self) -> str:
        return self.value

    @property
    def bases(self) -> tuple[str, str]:
        """Reference and alternate on the forward strand."""
        return self.value[0].upper(), self.value[1].upper()

    @property
    def allowed_refs(self) -> tuple[str, str]:
        """The reference base as either strand shows it."""
        return self.bases[0], COMPLEMENT[self.bases[0]]

    def alt_of(self, ref: str) -> str:
        """What editing turns a reference base into; N if it can't be edited."""
        first, alt = self.bases
        return {first: alt, COMPLEMENT[first]: COMPLEMENT[alt]}.get(ref.upper(), "N")

    def is_valid_ref(self, ref: str) -> bool:
        return ref.upper() in self.allowed_refs

    def alt_column(self, ref: Column) -> Column:
        first, second = self.allowed_refs
        return F.when(ref == first, self.alt_of(first)).when(ref == second, self.alt_of(second)).otherwise("N")

    def valid_column(self, ref: Column) -> Column:
        return F.substring(ref, 1, 1).isin(*self.allowed_refs)
