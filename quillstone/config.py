"""Settings: a nested mapping with dotted lookup, read once on the driver and captured as literals."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from quillstone.errors import ConfigurationError

#: The six header fields, in order.
FIELDS = ("invoice_number", "invoice_date", "vendor_name", "customer_name", "total_amount", "payment_due_date")

#: Default settings.
DEFAULTS: dict[str, Any] = {
    "input": {
        "supported_extensions": [".pdf", ".jpg", ".jpeg", ".png", ".tiff", ".bmp"],
        "pdf": {"dpi": 300, "first_page_only": True, "max_pages": 10},
        "image": {"max_width": 2480, "max_height": 3508, "min_width": 500, "min_height": 500, "auto_orient": True, "enhance_contrast": True, "target_dpi": 300},
    },
    "ocr": {
        "engine": "tesseract",
        "tesseract": {"lang": "eng", "psm": 3, "oem": 3, "config": "--dpi 300"},
        "easyocr": {"languages": ["en"], "gpu": False},
        "bbox": {"normalize": True, "scale_factor": 1000},
    },
    "model": {
        "name": "document-qa",
        "device": "cpu",
        "extraction_fields": {
            "invoice_number": {"question": "What is the invoice number?"},
            "invoice_date": {"question": "What is the invoice date?"},
            "vendor_name": {"question": "What is the vendor or seller name?"},
            "customer_name": {"question": "What is the customer or buyer name?"},
            "total_amount": {"question": "What is the total amount?"},
            "payment_due_date": {"question": "What is the payment due date?"},
        },
    },
    "postprocessing": {"validation": {"required_fields": ["invoice_number", "total_amount"], "flag_missing": True, "confidence_threshold": 0.5}},
    "output": {
        "excel": {"enabled": True, "filename_pattern": "extractions_{timestamp}.xlsx", "sheet_name": "Extracted Data", "include_metadata": True, "include_confidence": True},
        "database": {"enabled": True, "name": "extractions.db", "table_name": "invoice_headers", "create_if_not_exists": True, "avoid_duplicates": True},
    },
    "evaluation": {"partial_match_threshold": 0.8, "case_sensitive": False, "normalize_whitespace": True},
    "paths": {"input_dir": "input", "output_dir": "outputs"},
}


def merge(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """Both mappings, level by level; where both have a value, the one of ``over``."""
    out = dict(base)
    for key, value in over.items():
        both = isinstance(value, Mapping) and isinstance(out.get(key), Mapping)
        out[key] = merge(out[key], value) if both else value
    return out


@dataclass(frozen=True)
class Settings:
    """Immutable settings; ``get`` takes dotted names."""

    values: Mapping[str, Any] = field(default_factory=lambda: DEFAULTS)
    #: The file that they were read from.
    path: str | None = None

    def reload(self) -> Settings:
        """The settings as the file has them now."""
        return load(self.path)

    def get(self, name: str, default: Any = None) -> Any:
        at: Any = self.values
        for part in name.split("."):
            if not isinstance(at, Mapping) or part not in at:
                return default
            at = at[part]
        return at

    def get_all(self) -> dict[str, Any]:
        return dict(self.values)

    def with_values(self, over: Mapping[str, Any]) -> Settings:
        return Settings(merge(self.values, over), self.path)


def load(path: str | None = None) -> Settings:
    """Defaults overlaid by a YAML file; relative ``paths`` are resolved against the file's folder."""
    if path is None:
        return Settings()
    try:
        import yaml

        given = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    except OSError as e:
        raise ConfigurationError(f"settings can't be read: {path}", reason=str(e)) from e
    if not isinstance(given, Mapping):
        raise ConfigurationError(f"settings are no mapping: {path}")
    values = merge(DEFAULTS, given)
    root = Path(path).resolve().parent
    values["paths"] = {k: str(root / v) for k, v in values.get("paths", {}).items()}
    return Settings(values, path)
