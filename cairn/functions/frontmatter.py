"""YAML frontmatter.  The block is split off by column expressions; only YAML itself is read in Python, in batches."""
from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from cairn.functions.text import BLANKS

_TEXT, _TEXTS = T.StringType(), T.ArrayType(T.StringType())
FIELDS = T.StructType([T.StructField(n, t) for n, t in (("title", _TEXT), ("created", _TEXT), ("modified", _TEXT), ("tags", _TEXTS), ("aliases", _TEXTS), ("cssclasses", _TEXTS), ("raw", _TEXT))])


def has_block(content: Column) -> Column:
    return content.startswith("---") & (F.size(F.split(content, "---", 3)) >= 3)


def block(content: Column) -> Column:
    """The YAML text, null without frontmatter."""
    return F.when(has_block(content), F.get(F.split(content, "---", 3), F.lit(1)))


def body(content: Column) -> Column:
    trimmed = F.btrim(F.get(F.split(content, "---", 3), F.lit(2)), F.lit(BLANKS))
    return F.when(has_block(content), trimmed).otherwise(content)


def _strings(value) -> list[str]:
    if isinstance(value, str):
        return [value]
    return [str(v) for v in value] if isinstance(value, list) else []


#: Names and values that are text by YAML's rules and are written as they stand: they begin with a letter and hold no sign that YAML reads.
_NAME, _PLAIN = "[A-Za-z][A-Za-z0-9_]{0,49}", "[A-Za-z][A-Za-z0-9_]*(?:[ /-][A-Za-z0-9_]+)*"
_SIMPLE = re.compile(rf"\n?(?:{_NAME}:(?: {_PLAIN}\n|\n(?:(?:- {_PLAIN}\n)+|(?:  - {_PLAIN}\n)+)))+")
_ENTRY = re.compile(rf"({_NAME}):(?: ({_PLAIN})\n|\n((?: *- {_PLAIN}\n)+))")
_TEXT_ITEM = re.compile(rf"- ({_PLAIN})\n")
_IS_NAME, _IS_PLAIN = re.compile(_NAME), re.compile(_PLAIN)
#: The words among them that YAML reads as truth values or null.
_READ = frozenset(("yes", "no", "true", "false", "on", "off", "null"))


def _is_text(word: str, pattern: re.Pattern) -> bool:
    return bool(pattern.fullmatch(word)) and word.lower() not in _READ


def _simple(text: str) -> dict | None:
    """What YAML gives for a block of plain text values and lists of them; None for any other block."""
    if not _SIMPLE.fullmatch(text):
        return None
    found = {}
    for key, value, items in _ENTRY.findall(text):
        held = _TEXT_ITEM.findall(items) if items else value
        if key.lower() in _READ or any(x.lower() in _READ for x in (held if items else (held,))):
            return None
        found[key] = held
    return found


def _read(text: str | None) -> tuple[bool, object]:
    """Whether a block is YAML, and its value."""
    import yaml

    found = _simple(text or "")
    if found is not None:
        return True, found
    try:
        return True, yaml.safe_load(text or "")
    except yaml.YAMLError:
        return False, None


def _each(texts, read):
    """read(text) of all texts, once for equal ones; the values are shared: don't change them."""
    known = {}
    for text in texts:
        if text not in known:
            known[text] = read(text)
        yield known[text]


def _written(meta: dict) -> str:
    """The fields as YAML; those of plain text are written without the library, in its form."""
    import yaml

    lines = []
    for key in sorted(meta):
        value = meta[key]
        items = value if isinstance(value, list) else [value]
        if not items or not _is_text(key, _IS_NAME) or not all(isinstance(x, str) and len(key) + len(x) <= 70 and _is_text(x, _IS_PLAIN) for x in items):
            return yaml.dump(meta, default_flow_style=False, allow_unicode=True).strip()
        lines.append(f"{key}:" + ("".join(f"\n- {x}" for x in items) if isinstance(value, list) else f" {value}"))
    return "\n".join(lines)


def _load(text: str | None) -> dict:
    valid, found = _read(text)
    return found if valid and isinstance(found, dict) else {}


@F.pandas_udf(FIELDS)
def _fields(texts: pd.Series) -> pd.DataFrame:
    import json

    rows = []
    for meta in _each(texts, _load):
        text = (None if meta.get(k) is None else str(meta[k]) for k in ("title", "created", "modified"))
        rows.append((*text, _strings(meta.get("tags")), _strings(meta.get("aliases")), _strings(meta.get("cssclasses")), json.dumps(meta, default=str, ensure_ascii=False, sort_keys=True)))
    return pd.DataFrame(rows, columns=["title", "created", "modified", "tags", "aliases", "cssclasses", "raw"])


def parse(content: Column) -> Column:
    """Struct of the known fields; ``raw`` has all of them as JSON."""
    return _fields(block(content))


@F.pandas_udf(_TEXT)
def _render(raw: pd.Series, tags: pd.Series, text: pd.Series) -> pd.Series:
    import json

    out = []
    for meta, own, rest in zip(raw, tags, text):
        meta = json.loads(meta) if meta else {}
        if own is not None:
            meta["tags"] = list(own)
        out.append(f"---\n{_written(meta)}\n---\n\n{rest}" if meta else rest)
    return pd.Series(out)


def build(raw: Column, tags: Column, text: Column) -> Column:
    """A note from its fields (JSON), tags that replace those of the fields unless null, and body."""
    return _render(raw, tags, text)


def _retagged(content: Column, change) -> Column:
    meta = parse(content)
    return build(meta["raw"], change(F.coalesce(meta["tags"], F.array().cast("array<string>"))), body(content))


def add_tags(content: Column, tags: list[str]) -> Column:
    return _retagged(content, lambda own: F.array_union(own, F.array(*map(F.lit, tags))))


def remove_tags(content: Column, tags: list[str]) -> Column:
    return _retagged(content, lambda own: F.array_except(own, F.array(*map(F.lit, tags))))


def set_tags(content: Column, tags: list[str]) -> Column:
    return _retagged(content, lambda own: F.array(*map(F.lit, tags)).cast("array<string>"))


KINDS = T.StructType([T.StructField(n, _TEXT) for n in ("root", "tags", "aliases")])
#: What is said about a field whose value is of a kind; other pairs of field and kind are fine.
KIND_WARNINGS = {
    ("root", "invalid"): "invalid YAML", ("root", "other"): "frontmatter is not a mapping",
    ("tags", "null"): "tags is null, not a list", ("tags", "string"): "tags is a string, not a list", ("tags", "number"): "tags is a number, not a list",
    ("tags", "other"): "tags is not a list", ("tags", "mixed list"): "tags has items that are not strings",
    **{("aliases", kind): "aliases is not a list" for kind in ("null", "string", "number", "other")}, ("aliases", "mixed list"): "aliases has items that are not strings",
}


@F.pandas_udf(KINDS)
def _kinds(texts: pd.Series) -> pd.DataFrame:
    """Kinds of a block's YAML and of two of its fields; '' for a field that isn't there."""
    def kind(value) -> str:
        if isinstance(value, list):
            return "list" if all(isinstance(x, str) for x in value) else "mixed list"
        return next((name for types, name in ((type(None), "null"), (str, "string"), ((int, float), "number")) if isinstance(value, types)), "other")

    def kinds(text: str | None) -> tuple[str, str, str]:
        valid, found = _read(text)
        if not valid:
            return "invalid", "", ""
        own = found if isinstance(found, dict) else {}
        return "mapping" if isinstance(found, dict) else "other", *(kind(own[k]) if k in own else "" for k in ("tags", "aliases"))

    return pd.DataFrame(_each(texts, kinds), columns=["root", "tags", "aliases"])


def validate(content: Column) -> Column:
    """Warnings about the frontmatter; none if all is well.

    Repeated keys are found by their lines, as YAML itself keeps the last one only.
    """
    text, none = block(content), F.array().cast(_TEXTS)
    lines = F.transform(F.split(text, r"\R"), lambda x: F.btrim(x, F.lit(BLANKS)))
    keys = F.transform(F.filter(lines, lambda x: x.contains(":") & ~x.startswith("#")), lambda x: F.btrim(F.substring_index(x, ":", 1), F.lit(BLANKS)))
    repeated = F.transform(F.array(keys), lambda held: F.filter(held, lambda k, i: F.array_position(held, k) <= i))[0]
    said, kinds = F.create_map(*(F.lit(x) for (field, kind), text_ in KIND_WARNINGS.items() for x in (f"{field} {kind}", text_))), _kinds(text)
    of_kinds = F.array_compact(F.array(*(F.try_element_at(said, F.concat(F.lit(f"{field} "), kinds[field])) for field in ("root", "tags", "aliases"))))
    found = F.concat(F.transform(repeated, lambda k: F.concat(F.lit("duplicate key: "), k)), of_kinds)
    empty = F.btrim(text, F.lit(BLANKS)) == ""
    return F.when(~F.coalesce(content.startswith("---"), F.lit(False)), none).when(text.isNull(), F.array(F.lit("frontmatter is not closed"))).when(empty, F.array(F.lit("frontmatter is empty"))).otherwise(found)


def packed(values: Column) -> Column:
    """A list as one string that is guarded by commas, ',,' if empty."""
    return F.concat(F.lit(","), F.array_join(F.coalesce(values, F.array().cast("array<string>")), ","), F.lit(","))
