"""The record of company and bank details, and the settings of a run."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# The sixteen fields in order, their template aliases and their sheet labels.
ALIASES = {
    "company_name": "FULL_ORG_NAME",
    "short_name": "ORG_NAME",
    "legal_address": "LEGAL_ADDRES",
    "postal_address": "POST_ADDRES",
    "ogrn": "OGRN",
    "inn": "INN",
    "kpp": "KPP",
    "bank_name": "BANK_NAME",
    "checking_account": "RS",
    "correspondent_account": "KS",
    "bik": "BIK",
    "ceo_position": "CEO_POSITION",
    "ceo_fio_full": "CEO_FIO_FULL",
    "ceo_fio": "CEO_FIO",
    "phone": "TEL",
    "email": "E-MAIL",
}
FIELDS = tuple(ALIASES)

# The checked fields in the order of checks, with their labels in messages.
CHECKED = {
    "inn": "ИНН",
    "kpp": "КПП",
    "ogrn": "ОГРН",
    "bik": "БИК",
    "checking_account": "Расчётный счёт",
    "correspondent_account": "Корреспондентский счёт",
}

# Extension sets of the places where files come in.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "tiff", "tif", "bmp", "webp")
API_EXTENSIONS = ("pdf", "docx", "png", "jpg", "jpeg", "tiff", "bmp")
WEB_EXTENSIONS = ("pdf", "docx", "jpg", "jpeg", "png", "tiff")

CHECK = T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("value", T.StringType()), T.StructField("reason", T.StringType())])
DETAILS = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])


@dataclass(frozen=True)
class Settings:
    """Parameters of a run; the defaults are those of a plain batch."""

    max_chars: int = 12_000
    min_pdf_chars: int = 50
    max_upload_mb: int = 20
    provider: str = "mock"
    model: str = "gpt-4o-mini"
    api_key: str | None = None
    base_url: str | None = None
    temperature: float = 0.0
    max_tokens: int = 1024
    timeout_s: int = 120
    calls_at_once: int = 4
    prompt_version: str = "v1"
    ocr_cleanup: bool = False
    extensions: tuple[str, ...] = field(default=("pdf", "docx"))
