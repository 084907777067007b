"""Templates: a small JSON object of named patterns, kept on the driver as plan literals."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift import schemas
from pagesift.functions import patterns, text


class TemplateError(ValueError):
    """The template is not usable as a whole."""


@dataclass(frozen=True)
class Entry:
    """One pattern with what to do with its matches."""

    key: str
    ord: int
    extract: str
    extract_prepend: str = ""
    extract_append: str = ""
    validate: str = ""
    validate_browser: bool = False
    validate_browser_wait: float = 0.0
    validate_headers: Mapping[str, str] = field(default_factory=dict)
    validate_cookies: Mapping[str, str] = field(default_factory=dict)


Template = tuple[Entry, ...]

_ATTRIBUTES = {f.name for f in fields(Entry)} - {"key", "ord"}


def parse_template(source: str) -> Template:
    """Entries of a JSON object, in its order. Anything wrong rejects it all."""
    try:
        return entries_of(json.loads(source))
    except json.JSONDecodeError as error:
        raise TemplateError(f"not JSON: {error}") from error


def entries_of(template: Mapping[str, Mapping]) -> Template:
    """Entries by key. An unknown attribute or a missing pattern rejects the template."""
    try:
        return tuple(Entry(key=key, ord=i, **_attributes(key, a)) for i, (key, a) in enumerate(template.items()))
    except (AttributeError, TypeError) as error:
        raise TemplateError(f"not a template: {error}") from error


def _attributes(key: str, attributes: Mapping) -> dict:
    unknown = attributes.keys() - _ATTRIBUTES
    if unknown or "extract" not in attributes:
        raise TemplateError(f"{key}: unknown {sorted(unknown)}" if unknown else f"{key}: no extract")
    return {**attributes, "validate_browser_wait": float(attributes.get("validate_browser_wait", 0))}


def read_template(spark: SparkSession, path: str, encoding: str = text.ENCODING) -> Template:
    """Read, parse and check a template file."""
    content = spark.read.format("binaryFile").load(path).select(text.file_text(F.col("content"), encoding))
    template = parse_template(content.first()[0])
    patterns.check_patterns(spark, (p for e in template for p in (e.extract, e.validate) if p))
    for entry in template:
        patterns.group_index(entry.extract)
    return template


def template_for_stage(template: Template, stage: str) -> Template:
    """Entries that take part in a stage.

    Validation works on the survivors of extraction: an entry that extracts nothing validates nothing.
    """
    kept = tuple(e for e in template if e.extract)
    return kept if stage == schemas.EXTRACTION else tuple(e for e in kept if e.validate)


def lower_keys(pairs: Mapping[str, str]) -> dict[str, str]:
    """Lower-case names; of two names that become equal the later one counts."""
    return {name.lower(): value for name, value in pairs.items()}


def template_table(spark: SparkSession, template: Template) -> DataFrame:
    """The template as a table of ``schemas.TEMPLATE``. It is as small as the driver's own copy."""
    rows = [
        tuple(vars(replace(
            e,
            validate_headers=lower_keys(e.validate_headers),
            validate_cookies=lower_keys(e.validate_cookies),
        )).values())
        for e in template
    ]
    return spark.createDataFrame(rows, schemas.TEMPLATE)
