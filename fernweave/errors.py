"""What can go wrong, by kind."""


class EngineError(Exception):
    pass


class ConfigurationError(EngineError):
    pass


class InputError(EngineError, ValueError):
    pass


class IngestionError(EngineError):
    pass


class ParseError(IngestionError):
    pass


class EmptyDocumentError(IngestionError):
    pass


class DuplicateSourceError(EngineError):
    pass


class SourceNotFoundError(EngineError):
    pass


class MemoryNotFoundError(EngineError):
    pass


class EmbeddingError(IngestionError):
    pass


class IngestionInterruptedError(IngestionError):
    pass


class EnrichmentSkipped(IngestionError):
    """A step that was left out, and why; noted, not raised to the caller of an ingest."""

    def __init__(self, step: str, reason: str):
        super().__init__(f"{step}: {reason}")
        self.step, self.reason = step, reason


class GenerationError(EngineError):
    pass


class RetrievalError(EngineError):
    pass


class StoreError(EngineError):
    pass


class MemoryExtractionError(EngineError):
    pass
