"""Errors of the contract."""


class GlossaraError(Exception):
    """Base of all errors of this package."""


class NotFoundError(GlossaraError):
    """A term, node, conversation or resource that is asked for is not there."""


class InvalidInputError(GlossaraError, ValueError):
    """An argument or a row breaks the contract."""


class DimensionMismatchError(InvalidInputError):
    """A vector has another number of values than the table's."""


class TooLargeError(GlossaraError):
    """Input of an operator for small graphs is above its stated bound."""
