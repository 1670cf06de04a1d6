"""Column expressions for text and identifiers. All give null on null unless said otherwise."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that titles and queries drop.
TITLE_STOP_WORDS = ["a", "an", "and", "for", "from", "in", "of", "on", "the", "to", "with"]


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it (also inside its lambdas)."""
    return F.get(F.transform(F.array(value), body), 0)


def clean_ws(text: Column) -> Column:
    """Runs of white space as one blank, trimmed; nothing left is null."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def tokenize(text: Column, min_len: int = 2) -> Column:
    """Lower-case runs of a-z and 0-9 of at least min_len; null text has none."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1), lambda t: F.length(t) >= min_len)


def char_ngrams(text: Column, n: int = 4) -> Column:
    """Overlapping n-grams of the lower-case text with blanks collapsed; a shorter text is its own only gram, a blank one has none."""
    s = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))
    none = F.array().cast("array<string>")
    return let(s, lambda x: F.when(x == "", none).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - n + 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(n)))))


def norm_arxiv(raw: Column) -> Column:
    """The bare identifier: no resolver, prefix, version or letter case; null if nothing is left."""
    s = F.regexp_replace(F.lower(F.trim(raw)), r"^(https?://)?(www\.)?arxiv\.org/(abs|pdf)/", "")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"^arxiv:\s*", ""), r"\.pdf$", ""), r"v[0-9]+$", "")
    return F.nullif(F.trim(s), F.lit(""))


def norm_doi(raw: Column) -> Column:
    """Lower case, without resolver or doi: prefix; null if nothing is left."""
    s = F.regexp_replace(F.lower(F.trim(raw)), r"^(https?://)?(dx\.)?doi\.org/", "")
    return F.nullif(F.trim(F.regexp_replace(s, r"^doi:\s*", "")), F.lit(""))


def title_tokens(raw: Column) -> Column:
    return F.filter(tokenize(raw, 1), lambda t: ~t.isin(TITLE_STOP_WORDS))


def norm_title(raw: Column) -> Column:
    """The title's words without stop words, joined by blanks; empty for null."""
    return F.array_join(title_tokens(raw), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets: both empty 1, one empty 0."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0)).otherwise(F.coalesce(F.try_divide(both.cast("double"), (F.size(x) + F.size(y) - both).cast("double")), F.lit(0.0)))


def content_hash(*parts: Column) -> Column:
    """sha1 of the parts, each ended by a NUL; null parts count as empty."""
    return F.sha1(F.concat(*[x for p in parts for x in (F.coalesce(p, F.lit("")), F.lit("\0"))]))


def extract_numbers(text: Column) -> Column:
    """Decimal numbers in the text, in order, as strings."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"), 1)


def contains_entity(text: Column, entity: Column) -> Column:
    """Whether the entity occurs as a whole phrase, letter case aside."""
    padded = F.concat(F.lit(" "), F.array_join(tokenize(text, 1), " "), F.lit(" "))
    return padded.contains(F.concat(F.lit(" "), F.array_join(tokenize(entity, 1), " "), F.lit(" ")))


def parse_bool_first(text: Column) -> Column:
    """The first true/yes or false/no in the text, else null."""
    word = F.regexp_extract(F.lower(text), r"\b(true|false|yes|no)\b", 1)
    return F.when(word.isin("true", "yes"), F.lit(True)).when(word.isin("false", "no"), F.lit(False))


def year_of(text: Column) -> Column:
    """The first year from 1500 to 2100 in a free text, else null."""
    years = F.filter(F.regexp_extract_all(text, F.lit(r"([0-9]{4})"), 1), lambda y: y.cast("int").between(1500, 2100))
    return F.get(years, 0).cast("int")


def slug(name: Column) -> Column:
    """Lower-case words joined by dashes, with six hex digits of the name's sha1."""
    return F.concat(F.array_join(tokenize(name, 1), "-"), F.lit("-"), F.substring(F.sha1(name), 1, 6))


def fold(text: Column) -> Column:
    """Lower case with the diacritics of Latin letters dropped."""
    return F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy")


def at_path(doc: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text, as text; a step of digits is a place in a list. Null where the path leads nowhere or the text is no JSON."""
    steps = "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split("."))
    return F.get_json_object(doc, "$" + steps)


def flat_numbers(doc: Column) -> Column:
    """All numbers of a JSON text as (path, number), with dotted paths to any depth; texts that are no JSON have none. Depth is not known beforehand, so no built-in expression can say it: batches of texts go through Arrow."""
    @F.pandas_udf("array<struct<path:string,number:double>>")
    def walk(texts: pd.Series) -> pd.Series:
        def of(text: str | None) -> list:
            try:
                todo = [("", json.loads(text))] if text else []
            except ValueError:
                return []
            out = []
            while todo:
                path, x = todo.pop()
                if isinstance(x, dict):
                    todo += [(f"{path}.{k}" if path else k, v) for k, v in x.items()]
                elif isinstance(x, list):
                    todo += [(f"{path}.{i}" if path else str(i), v) for i, v in enumerate(x)]
                elif isinstance(x, int | float) and not isinstance(x, bool):
                    out.append({"path": path, "number": float(x)})
            return sorted(out, key=lambda r: r["path"])

        return texts.map(of, na_action=None)

    return walk(doc)
