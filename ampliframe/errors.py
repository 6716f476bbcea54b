"""Errors of reading input."""


class InputError(ValueError):
    """Any fault of an input file."""


class NoRecords(InputError):
    """Not FASTA, or empty."""


class RepeatedName(InputError):
    """Two records of one name."""


class UnequalLengths(InputError):
    """Aligned records of different lengths."""


class NotABase(InputError):
    """A character that is no IUPAC code and no gap."""
