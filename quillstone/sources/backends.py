"""Page backends: rendering, image preparation, recognition and question answering.

A backend is a factory that imports its library where it runs.  The registry
resolves names on the driver, with fallbacks, so that a job fails before it
starts rather than in every task.  All stages run as ``mapInPandas`` over
small batches, keep row errors as columns, and never shuffle pixels.
"""

from __future__ import annotations

import importlib.util
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.config import FIELDS, Settings
from quillstone.errors import ModelLoadError, OCREngineNotAvailableError

#: Pages that cross to Python together; pixels are large.
BATCH_ROWS = 8

WORDS = "array<struct<text:string,left:int,top:int,width:int,height:int,conf:double,line_num:int>>"
RENDERED = "path string, page_idx int, image binary, width int, height int, text string, metadata map<string,string>, success boolean, error string"
RECOGNISED = f"path string, page_idx int, words {WORDS}, image_width int, image_height int, language string, engine string, processing_time double, success boolean, error string"
ANSWERED = "path string, page_idx int, answers map<string,struct<question:string,answer:string,confidence:double>>, processing_time double, success boolean, error string"


@dataclass(frozen=True)
class Backend:
    """A named factory and the modules that it needs on the executors."""

    name: str
    make: Callable[[Settings], Callable[..., Any]]
    needs: tuple[str, ...] = ()

    def available(self) -> bool:
        return all(importlib.util.find_spec(m) is not None for m in self.needs)


@dataclass
class Registry:
    """Backends of one kind; an unknown or missing one falls back to ``default``."""

    kind: str
    default: str
    known: dict[str, Backend] = field(default_factory=dict)

    def add(self, backend: Backend) -> Backend:
        self.known[backend.name] = backend
        return backend

    def resolve(self, name: str, strict: bool = False) -> Backend:
        wanted = self.known.get(name)
        if wanted is not None and wanted.available():
            return wanted
        fallback = self.known.get(self.default)
        if strict or fallback is None or not fallback.available():
            raise OCREngineNotAvailableError(name) if self.kind == "ocr" else ModelLoadError(name, f"no {self.kind} backend")
        return fallback

    def info(self) -> dict[str, bool]:
        return {n: b.available() for n, b in self.known.items()}


PDF, OCR, QA = Registry("pdf", "pymupdf"), Registry("ocr", "tesseract"), Registry("qa", "document-qa")


# --- rendering -----------------------------------------------------------------------------------------------------


def _pymupdf(settings: Settings) -> Callable[[bytes], Iterator[dict]]:
    import fitz

    zoom = settings.get("input.pdf.dpi", 300) / 72
    most = 1 if settings.get("input.pdf.first_page_only", True) else settings.get("input.pdf.max_pages", 10)

    def render(content: bytes) -> Iterator[dict]:
        with fitz.open(stream=content, filetype="pdf") as doc:
            meta = {f"pdf_{k}": str(v) for k, v in (doc.metadata or {}).items() if v} | {"total_pages": str(doc.page_count)}
            for i in range(min(most, doc.page_count)):
                pix = doc[i].get_pixmap(matrix=fitz.Matrix(zoom, zoom), colorspace=fitz.csRGB)
                yield {"image": pix.tobytes("png"), "width": pix.width, "height": pix.height, "text": doc[i].get_text(), "metadata": meta}

    return render


def _poppler(settings: Settings) -> Callable[[bytes], Iterator[dict]]:
    import io

    import pdf2image

    most = 1 if settings.get("input.pdf.first_page_only", True) else settings.get("input.pdf.max_pages", 10)
    told = {"Title": "pdf_title", "Author": "pdf_author", "Creator": "pdf_creator", "CreationDate": "pdf_creationDate", "Pages": "total_pages"}

    def texts(content: bytes) -> list[str]:
        """Text of the pages, where the library that reads it is there."""
        try:
            import pdfplumber

            with pdfplumber.open(io.BytesIO(content)) as doc:
                return [p.extract_text() or "" for p in doc.pages[:most]]
        except Exception:  # noqa: BLE001 - a page without text is a scanned one
            return []

    def render(content: bytes) -> Iterator[dict]:
        info = pdf2image.pdfinfo_from_bytes(content)
        meta = {name: str(info[k]) for k, name in told.items() if info.get(k)}
        found = texts(content)
        for i, image in enumerate(pdf2image.convert_from_bytes(content, dpi=settings.get("input.pdf.dpi", 300), first_page=1, last_page=most)):
            out = io.BytesIO()
            image.convert("RGB").save(out, "PNG")
            yield {"image": out.getvalue(), "width": image.width, "height": image.height, "text": found[i] if i < len(found) else None, "metadata": meta}

    return render


PDF.add(Backend("pymupdf", _pymupdf, ("fitz",)))
PDF.add(Backend("poppler", _poppler, ("pdf2image",)))


def prepare_image(settings: Settings) -> Callable[[bytes], dict]:
    """Orient, convert to RGB on white, shrink to the limits, enhance; one fused function a page."""
    import io

    from PIL import Image, ImageEnhance, ImageOps

    get = lambda name, default: settings.get(f"input.image.{name}", default)

    def run(content: bytes) -> dict:
        image = Image.open(io.BytesIO(content))
        meta = {"original_width": image.width, "original_height": image.height, "original_mode": image.mode, "original_format": image.format, "dpi": (image.info.get("dpi") or (get("target_dpi", 300),))[0], "page_count": 1}
        if get("auto_orient", True):
            image = ImageOps.exif_transpose(image)
        if image.mode == "RGBA":
            white = Image.new("RGB", image.size, (255, 255, 255))
            white.paste(image, mask=image.getchannel("A"))
            image = white
        image = image.convert("RGB")
        ratio = min(get("max_width", 2480) / image.width, get("max_height", 3508) / image.height)
        if ratio < 1:
            image = image.resize((int(image.width * ratio), int(image.height * ratio)), Image.Resampling.LANCZOS)
        if get("enhance_contrast", True):
            image = ImageEnhance.Sharpness(ImageEnhance.Contrast(image).enhance(1.2)).enhance(1.1)
        if get("binarize", False):
            image = image.convert("L").point(lambda v: 255 if v > 128 else 0).convert("RGB")
        if get("denoise", False):
            from PIL import ImageFilter

            image = image.filter(ImageFilter.MedianFilter(3))
        out = io.BytesIO()
        image.save(out, "PNG")
        meta |= {"processed_width": image.width, "processed_height": image.height}
        return {"image": out.getvalue(), "width": image.width, "height": image.height, "text": None, "metadata": {k: str(v) for k, v in meta.items()}}

    return run


def render_pages(files: DataFrame, settings: Settings | None = None, pdf: str = "pymupdf", image: Callable[[Settings], Callable[[bytes], dict]] = prepare_image) -> DataFrame:
    """One row a page of every loaded file; a file that can't be rendered is one row with its error."""
    settings = settings or Settings()
    backend = PDF.known.get(pdf)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[str, Any] = {}
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                try:
                    if r.file_type not in made:
                        made[r.file_type] = backend.make(settings) if r.file_type == "pdf" else image(settings)
                    pages = made[r.file_type](bytes(r.content)) if r.file_type == "pdf" else [made[r.file_type](bytes(r.content))]
                    rows += [{"path": r.path, "page_idx": i, **p, "success": True, "error": None} for i, p in enumerate(pages)]
                except Exception as e:  # noqa: BLE001 - a broken file is a row, whatever the library raises
                    rows.append({"path": r.path, "page_idx": 0, "image": None, "width": None, "height": None, "text": None, "metadata": {}, "success": False, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=["path", "page_idx", "image", "width", "height", "text", "metadata", "success", "error"])

    return files.where("success").select("path", "file_type", "content").mapInPandas(run, RENDERED)


# --- recognition ---------------------------------------------------------------------------------------------------


def tesseract_flags(settings: Settings) -> str:
    get = lambda name, default: settings.get(f"ocr.tesseract.{name}", default)
    return " ".join(x for x in (f"--psm {get('psm', 3)}", f"--oem {get('oem', 3)}", str(get("config", "") or "")) if x)


def _tesseract(settings: Settings) -> Callable[[bytes], list[dict]]:
    import io

    import pytesseract
    from PIL import Image

    def run(image: bytes) -> list[dict]:
        d = pytesseract.image_to_data(Image.open(io.BytesIO(image)), lang=settings.get("ocr.tesseract.lang", "eng"), config=tesseract_flags(settings), output_type=pytesseract.Output.DICT)
        return [{"text": d["text"][i], **{k: int(d[k][i]) for k in ("left", "top", "width", "height", "line_num")}, "conf": float(d["conf"][i])} for i in range(len(d["text"]))]

    return run


def quad_word(quad: list[tuple[float, float]], text: str, share: float, line: int) -> dict:
    """A recognised quadrilateral as an upright box, its confidence in per cent."""
    xs, ys = [int(p[0]) for p in quad], [int(p[1]) for p in quad]
    return {"text": text, "left": min(xs), "top": min(ys), "width": max(xs) - min(xs), "height": max(ys) - min(ys), "conf": share * 100, "line_num": line}


def _easyocr(settings: Settings) -> Callable[[bytes], list[dict]]:
    import easyocr

    reader = easyocr.Reader(settings.get("ocr.easyocr.languages", ["en"]), gpu=settings.get("ocr.easyocr.gpu", False))
    return lambda image: [quad_word(q, t, c, i) for i, (q, t, c) in enumerate(reader.readtext(image))]


def _paddleocr(settings: Settings) -> Callable[[bytes], list[dict]]:
    import io

    import numpy as np
    from paddleocr import PaddleOCR
    from PIL import Image

    engine = PaddleOCR(lang="en")
    return lambda image: [quad_word(q, t, c, i) for i, (q, (t, c)) in enumerate((engine.ocr(np.asarray(Image.open(io.BytesIO(image)))) or [[]])[0] or [])]


OCR.add(Backend("tesseract", _tesseract, ("pytesseract", "PIL")))
OCR.add(Backend("easyocr", _easyocr, ("easyocr",)))
OCR.add(Backend("paddleocr", _paddleocr, ("paddleocr", "PIL")))


def recognise(pages: DataFrame, backend: Backend, settings: Settings | None = None) -> DataFrame:
    """The words of every page, in the engine's own form; a failed page has none, and its error."""
    settings = settings or Settings()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = None
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                began, words, error = time.monotonic(), [], None
                try:
                    engine = engine or backend.make(settings)
                    words = engine(bytes(r.image))
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"
                rows.append((r.path, r.page_idx, words, r.width, r.height, settings.get("ocr.tesseract.lang", "eng"), backend.name, time.monotonic() - began, error is None, error))
            yield pd.DataFrame(rows, columns=["path", "page_idx", "words", "image_width", "image_height", "language", "engine", "processing_time", "success", "error"])

    return pages.select("path", "page_idx", "image", "width", "height").mapInPandas(run, RECOGNISED)


def recognised_text(pages: DataFrame, backend: Backend, settings: Settings | None = None) -> DataFrame:
    """Text only: a narrower schema where boxes are not needed; empty where a page fails."""
    settings = settings or Settings()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = None
        for batch in batches:
            texts = []
            for image in batch["image"]:
                try:
                    engine = engine or backend.make(settings)
                    texts.append(" ".join(w["text"] for w in engine(bytes(image)) if w["text"].strip()))
                except Exception:  # noqa: BLE001
                    texts.append("")
            yield batch[["path", "page_idx"]].assign(text=texts)

    return pages.select("path", "page_idx", "image").mapInPandas(run, "path string, page_idx int, text string")


def _tesseract_orientation(settings: Settings) -> Callable[[bytes], dict]:
    import io

    import pytesseract
    from PIL import Image

    def run(image: bytes) -> dict:
        d = pytesseract.image_to_osd(Image.open(io.BytesIO(image)), output_type=pytesseract.Output.DICT)
        return {"orientation": int(d.get("orientation", 0)), "rotate": int(d.get("rotate", 0)), "script": d.get("script"), "confidence": float(d.get("orientation_conf", 0))}

    return run


ORIENTED = "path string, page_idx int, orientation int, rotate int, script string, confidence double"


def orientation(pages: DataFrame, make: Callable[[Settings], Callable[[bytes], dict]] = _tesseract_orientation, settings: Settings | None = None) -> DataFrame:
    """Orientation and script of every page; zeros and no script where they can't be told."""
    settings = settings or Settings()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look = None
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                try:
                    look = look or make(settings)
                    d = look(bytes(r.image))
                except Exception:  # noqa: BLE001
                    d = {}
                rows.append((r.path, r.page_idx, d.get("orientation", 0), d.get("rotate", 0), d.get("script"), d.get("confidence", 0.0)))
            yield pd.DataFrame(rows, columns=["path", "page_idx", "orientation", "rotate", "script", "confidence"])

    return pages.select("path", "page_idx", "image").mapInPandas(run, ORIENTED)


def languages(listed: Callable[[], list[str]] | None = None) -> list[str]:
    """Languages of the recognition engine on the driver, without orientation data; English where it can't be asked."""
    try:
        if listed is None:
            import pytesseract

            listed = pytesseract.get_languages
        return sorted(x for x in listed() if x != "osd")
    except Exception:  # noqa: BLE001
        return ["eng"]


def engine_arrays(pages: DataFrame) -> DataFrame:
    """The words of a page as the parallel arrays that the layout operators read."""
    names = ("text", "left", "top", "width", "height", "conf", "line_num")
    return pages.select("path", "page_idx", "image_width", "image_height", *[F.col("words")[n].alias(n) for n in names])


# --- question answering --------------------------------------------------------------------------------------------


def questions(settings: Settings | None = None) -> dict[str, str]:
    settings = settings or Settings()
    return {f: settings.get(f"model.extraction_fields.{f}.question", f"What is the {f.replace('_', ' ')}?") for f in FIELDS}


def model_info(settings: Settings | None = None, backend: Backend | None = None) -> dict[str, Any]:
    """Name, device and questions of the model that a run would use."""
    settings = settings or Settings()
    return {"model_name": settings.get("model.name"), "device": settings.get("model.device", "cpu"), "backend": backend.name if backend else None, "questions": questions(settings)}


def _document_qa(settings: Settings) -> Callable[[bytes, str, str], tuple[str | None, float]]:
    import io

    from PIL import Image
    from transformers import pipeline

    device = 0 if settings.get("model.device", "cpu") == "cuda" else -1
    model = pipeline("document-question-answering", model=settings.get("model.name"), device=device)

    def ask(image: bytes, text: str, question: str) -> tuple[str | None, float]:
        got = model(Image.open(io.BytesIO(image)), question)
        best = got[0] if isinstance(got, list) and got else got
        return (best["answer"], float(best["score"])) if best else (None, 0.0)

    return ask


def _text_qa(settings: Settings) -> Callable[[bytes, str, str], tuple[str | None, float]]:
    from transformers import pipeline

    model = pipeline("question-answering", model=settings.get("model.text_name"))

    def ask(image: bytes, text: str, question: str) -> tuple[str | None, float]:
        got = model(question=question, context=text) if text else None
        return (got["answer"], float(got["score"])) if got else (None, 0.0)

    return ask


QA.add(Backend("document-qa", _document_qa, ("transformers", "PIL")))
QA.add(Backend("text-qa", _text_qa, ("transformers",)))


def answer(pages: DataFrame, backend: Backend, settings: Settings | None = None) -> DataFrame:
    """Every question of every page of (path, page_idx, image, text); a question that fails has no answer and confidence 0."""
    settings = settings or Settings()
    asked = questions(settings)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                began, answers, error = time.monotonic(), {}, None
                try:
                    model = model or backend.make(settings)
                    for f, q in asked.items():
                        try:
                            text, score = model(None if r.image is None else bytes(r.image), r.text or "", q)
                        except Exception:  # noqa: BLE001
                            text, score = None, 0.0
                        answers[f] = {"question": q, "answer": text, "confidence": score}
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"
                rows.append((r.path, r.page_idx, answers, time.monotonic() - began, error is None, error))
            yield pd.DataFrame(rows, columns=["path", "page_idx", "answers", "processing_time", "success", "error"])

    return pages.select("path", "page_idx", "image", "text").mapInPandas(run, ANSWERED)
