"""Errors that callers may catch."""


class DocumentProcessingError(Exception):
    """A document could not be read, chunked, embedded or indexed."""


class GenerationError(Exception):
    """An answer could not be generated."""
