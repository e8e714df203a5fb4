"""Exceptions; each is also the builtin that callers may already catch."""


class FragsparkError(Exception):
    """Base of all errors of this package."""


class InvalidInputError(FragsparkError, ValueError):
    """An argument or a row that no operator can take."""


class UnsupportedFormatError(InvalidInputError):
    """A file whose format has no reader or writer here."""


class MissingReferenceError(InvalidInputError):
    """A format that can't be decoded without a reference sequence."""


class MissingIndexError(FragsparkError, FileNotFoundError):
    """A region was asked of a file without its index."""


class ContigNotFoundError(InvalidInputError, KeyError):
    """A contig that the reference or the sizes don't have."""


class ContigMismatchError(InvalidInputError):
    """Two inputs whose contigs don't fit together."""


class OutOfBoundsError(InvalidInputError, IndexError):
    """Coordinates past the end of a contig."""
