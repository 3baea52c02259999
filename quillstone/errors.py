"""Errors of driver-side work.  Errors of single rows are columns, never exceptions."""

from __future__ import annotations


class QuillstoneError(Exception):
    """Base of all errors, with a message and optional details."""

    def __init__(self, message: str, **details: object):
        super().__init__(message)
        self.message = message
        self.details = details

    def __str__(self) -> str:
        return f"{self.message} | Details: {self.details}" if self.details else self.message


class InputError(QuillstoneError):
    """Files that can't be taken in."""


class UnsupportedFileTypeError(InputError):
    def __init__(self, path: str, supported: tuple[str, ...] = ()):
        super().__init__(f"unsupported file type: {path}", path=path, supported=list(supported))


class MissingFileError(InputError):
    def __init__(self, path: str):
        super().__init__(f"file not found: {path}", path=path)


class CorruptedFileError(InputError):
    def __init__(self, path: str, reason: str = ""):
        super().__init__(f"file can't be read: {path}", path=path, reason=reason)


class OCRError(QuillstoneError):
    """Text recognition."""


class OCREngineNotAvailableError(OCRError):
    def __init__(self, engine: str):
        super().__init__(f"OCR engine not available: {engine}", engine=engine)


class OCRProcessingError(OCRError):
    def __init__(self, path: str, reason: str = ""):
        super().__init__(f"OCR failed: {path}", path=path, reason=reason)


class ModelError(QuillstoneError):
    """Question answering models."""


class ModelLoadError(ModelError):
    def __init__(self, name: str, reason: str = ""):
        super().__init__(f"model can't be loaded: {name}", name=name, reason=reason)


class InferenceError(ModelError):
    def __init__(self, reason: str):
        super().__init__(f"inference failed: {reason}", reason=reason)


class PostProcessingError(QuillstoneError):
    """Normalisation and validation."""


class ValidationError(PostProcessingError):
    def __init__(self, field: str, reason: str = ""):
        super().__init__(f"validation failed: {field}", field=field, reason=reason)


class OutputError(QuillstoneError):
    """Sinks."""


class DatabaseError(OutputError):
    def __init__(self, operation: str, reason: str = ""):
        super().__init__(f"database {operation} failed", operation=operation, reason=reason)


class WorkbookError(OutputError):
    def __init__(self, path: str, reason: str = ""):
        super().__init__(f"workbook can't be written: {path}", path=path, reason=reason)


class ConfigurationError(QuillstoneError):
    """Settings and ground truth that can't be used."""
