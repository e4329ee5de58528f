"""Text helpers: ``Column -> Column``, all built from Spark functions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns and suffixes the references, packages and files follow.
REFERENCE = "gitUri=(.*)&subPath=(.*)&tag=(.*)&projectSubscriptionProjectId=(.*)&path=(.*)"
REFERENCE_FIELDS = ("git_uri", "sub_path", "tag", "project_id", "path")
PACKAGE = r"pipeline/(.*?)-([\d.]+)-py3-none-any\.whl"
JAR_SUFFIX = r"_2\.(12|13)\.jar$"
TEMPLATE_SUFFIXES = (".json", ".scala", ".py")


def reference_fields(text: Column) -> Column:
    """Split a reference into a struct of its five fields, all null without a match.

    Of the tag only the part behind the first ``/`` (up to the next) is kept. The fields
    cannot contain line breaks, so one replacement hands all of them over, divided by
    those; it is shorter than the text, which tells a match from a miss.
    """
    lines = "\n".join(f"${i}" for i in range(1, len(REFERENCE_FIELDS) + 1))
    replaced = F.regexp_replace(text, f"(?d)(?s:^.*?){REFERENCE}(?s:.*$)", lines)
    found = F.when(text.contains("gitUri=") & text.contains("&path="), replaced)
    parts = F.when(found != text, F.split(found, "\n", -1))
    fields = {name: parts[i] for i, name in enumerate(REFERENCE_FIELDS)}
    fields["tag"] = F.try_element_at(F.split(fields["tag"], "/"), F.lit(2))
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def package_parts(path: Column) -> Column:
    """Struct of package ``name`` and ``version`` found in a path, null without a match."""
    matched = path.rlike(PACKAGE)
    return F.struct(
        F.when(matched, F.regexp_extract(path, PACKAGE, 1)).alias("name"),
        F.when(matched, F.regexp_extract(path, PACKAGE, 2)).alias("version"),
    )


def jar_version(path: Column) -> Column:
    """Language version a jar name ends with (``2.12`` or ``2.13``), else null."""
    return F.when(path.rlike(JAR_SUFFIX), F.concat(F.lit("2."), F.regexp_extract(path, JAR_SUFFIX, 1)))


def normalise_name(name: Column) -> Column:
    """Runs of other characters than letters, digits, ``_`` and ``.`` become one ``_``."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}.]+", "_")


def substitute(name: Column, text: Column, values: Mapping[str, str]) -> Column:
    """Replace placeholders, literally and in order, in files that take part in templating."""
    replaced = text
    for placeholder, value in values.items():
        replaced = F.replace(replaced, F.lit(placeholder), F.lit(value))
    return F.when(ends_with_any(name, TEMPLATE_SUFFIXES), replaced).otherwise(text)


def ends_with_any(name: Column, suffixes: Sequence[str]) -> Column:
    return name.rlike("(" + "|".join(re.escape(suffix) for suffix in suffixes) + ")$")


def strip_prefix(text: Column, prefix: str | Column) -> Column:
    """``text`` without one leading ``prefix``."""
    prefix = F.lit(prefix)
    return F.when(F.startswith(text, prefix), F.substr(text, F.length(prefix) + 1)).otherwise(text)


def is_blank(text: Column) -> Column:
    """True for null, empty and white space only."""
    return text.isNull() | ~text.rlike(r"[^\p{Z}\s\x1c-\x1f\x85]")


def bucket_of(path: Column, scheme: str | Column) -> Column:
    """The first part of a path, with the scheme taken out."""
    return F.split_part(F.replace(path, F.lit(scheme), F.lit("")), F.lit("/"), F.lit(1))


def prefix_of(path: Column, scheme: str | Column) -> Column:
    """All parts of a path behind the bucket, empty if there are none."""
    parts = F.split(F.replace(path, F.lit(scheme), F.lit("")), "/", -1)
    return F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), "/")


def part_behind(path: Column, marker: str | Column, n: int | Column) -> Column:
    """The ``n``-th path part behind the first ``marker``, null without the marker."""
    behind = F.split_part(path, F.lit(marker), F.lit(2))
    return F.when(path.contains(marker), F.split_part(behind, F.lit("/"), F.lit(n)))


def same_on(left: Mapping[str, Column], right: Mapping[str, Column]) -> Column:
    """True where two rows agree on every named column, nulls counting as equal."""
    same = F.lit(True)
    for name, value in left.items():
        same = same & value.eqNullSafe(right[name])
    return same


def short_hash(text: Column) -> Column:
    """First eight hex digits of the SHA-256 of a text."""
    return F.substring(F.sha2(text, 256), 1, 8)


def _holds_old(value: Column, old: str, new: str) -> Column:
    return value.contains(old) & ~value.contains(new)


def is_stale(path: Column, text: Column, old: str, new: str, json_values: Column | None = None) -> Column:
    """Whether a file still refers to ``old`` and not to ``new``; the file type decides how.

    Python files must hold ``old`` in quotes or as a whole word (below ``jobs/`` only
    in quotes). A JSON file is judged by ``json_values``, the references parsed from
    it: one must equal ``old``, or contain it without ``new``; where ``json_values``
    is null (text that cannot be parsed) and in YAML files, the whole text must
    contain ``old`` and not ``new``. Other files and build folders are never stale.
    """
    word = re.escape(old)
    in_jobs = path.startswith("jobs/") | path.contains("/jobs/")
    quoted = text.rlike(f"[\"']{word}[\"']")
    whole_word = text.rlike(rf"(?U)\b{word}\b")
    anywhere = _holds_old(text, old, new)
    by_value = anywhere
    if json_values is not None:
        by_value = F.coalesce(
            F.exists(json_values, lambda value: (value == old) | _holds_old(value, old, new)), anywhere
        )
    stale = (
        F.when(path.rlike("(build|dist|__pycache__).*/"), False)
        .when(path.endswith(".py"), (quoted | (whole_word & ~in_jobs)) & ~text.contains(new))
        .when(path.endswith(".json"), by_value)
        .when(path.rlike(r"\.ya?ml$"), anywhere & ~in_jobs)
        .otherwise(False)
    )
    return F.coalesce(stale, F.lit(False))
