"""Scalar text functions as column expressions.  Patterns follow Unicode white space, as str.split does."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

SPACE = r"(?U)\s+"
#: The characters with Unicode's property White_Space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SNIPPET = 300
BUDGET_WORDS = 3000
WIKI_LINK = r"(?<!!)\[\[([^\[\]\n]+)\]\]"


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def words(text: Column) -> Column:
    """Words between white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def sanitize(text: Column) -> Column:
    """Without URLs and empty parentheses, runs of blanks other than line ends as one space, trimmed."""
    text = F.regexp_replace(text, r"(?U)https?://\S+", "")
    text = F.regexp_replace(text, r"(?U)\(\s*\)", "")
    text = F.regexp_replace(text, r"(?U)[^\S\r\n]+", " ")
    return F.btrim(text, F.lit(BLANKS))


def truncate_snippet(text: Column, limit: int = SNIPPET) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def truncate_to_budget(text: Column, budget: int = BUDGET_WORDS) -> Column:
    return F.when(word_count(text) > budget, F.concat(F.array_join(F.slice(words(text), 1, budget), " "), F.lit("\n\n[truncated]"))).otherwise(text)


def tokenize(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, of two characters at least."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]{2,})"), F.lit(1))


def title_of_path(path: Column) -> Column:
    """Base name without its extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def normalize_title(title: Column) -> Column:
    """lower() stands in for case folding: it differs for few letters (sharp s, final sigma)."""
    return F.lower(title)


def normalize_vault_path(path: Column, vault: str = "") -> Column:
    """Slashes instead of back-slashes, without the vault's own prefix."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    prefix = vault.replace("\\", "/").rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path) if vault else path


def is_valid_path(path: Column) -> Column:
    """No segment of the path is '..'."""
    return ~F.array_contains(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), "..")


def normalize_link(target: Column) -> Column:
    """A wiki-link's target: without display text, section, outer slashes and .md, folded."""
    t = F.trim(F.substring_index(F.substring_index(target, "|", 1), "#", 1))
    t = F.regexp_replace(F.replace(t, F.lit("\\"), F.lit("/")), "/+", "/")
    t = F.regexp_replace(t, "^/+|/+$", "")
    return F.lower(F.regexp_replace(t, r"(?i)\.md$", ""))


def wiki_links(content: Column) -> Column:
    """Normalised targets of all links but embeddings, in order, each once."""
    found = F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(WIKI_LINK), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, normalize_link), lambda t: t != ""))


def sanitize_filename(name: Column) -> Column:
    return F.regexp_replace(name, r'[<>:"/\\|?*]', "")


def auto_title(content: Column, limit: int = 60) -> Column:
    """The first line with text, without heading marks, cut."""
    lines = F.filter(F.transform(F.split(content, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), "^#+", ""))), lambda x: x != "")
    return sanitize_filename(F.trim(F.substring(F.coalesce(F.get(lines, F.lit(0)), F.lit("Untitled")), 1, limit)))
