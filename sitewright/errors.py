"""Errors of the library."""


class SiteError(Exception):
    """Base of all errors raised on purpose."""


class MissingFile(SiteError):
    pass


class EmptyData(SiteError):
    pass


class DimensionMismatch(SiteError):
    pass


class InvalidInput(SiteError, ValueError):
    pass


class InvalidConfig(SiteError, ValueError):
    pass


class UnsupportedFormat(SiteError):
    pass


class ParseFailure(SiteError, ValueError):
    pass


class ThreadSetup(SiteError):
    pass


class ReferenceLookup(SiteError, LookupError):
    pass
