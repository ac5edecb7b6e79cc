"""Keys that live in file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decoded(path: Column) -> Column:
    """Undo the URL encoding of ``_metadata.file_path`` and the escapes of partition directories.

    A plus sign is a plus sign.
    """
    for _ in range(2):
        path = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return path


def path_text(path: Column) -> Column:
    """Path as ``/part/part/``, where an underscore separates like a slash; .json is dropped.

    The equals sign of a partition directory separates too, so ``task=equal`` yields ``equal``.
    """
    parts = F.replace(F.translate(path, "_=", "//"), F.lit(".json"), F.lit(""))
    return F.concat(F.lit("/"), parts, F.lit("/"))


def key_from_path(
    text: Column, vocabulary: list[str], default: str | None = None, ignore_case: bool = False
) -> Column:
    """First vocabulary entry, in vocabulary order, that is a part of ``path_text``.

    Case matters unless ``ignore_case`` is set, which expects a lower-case text.
    """
    out = F.lit(default).cast("string")
    for word in reversed([w for w in vocabulary if "/" not in w]):
        part = word.lower() if ignore_case else word
        out = F.when(text.contains(f"/{part}/"), F.lit(word)).otherwise(out)
    return out


def path_keys(
    path: Column,
    vocabularies: dict[str, list[str]],
    required: list[str],
    defaults: dict[str, str] | None = None,
    ignore_case: bool = False,
) -> Column:
    """All keys of a path as one struct; NULL if a required key is absent.

    The path text is bound once and looked up for every word, whatever the optimizer does with
    the expression around it.
    """
    defaults = defaults or {}
    text = F.lower(path_text(path)) if ignore_case else path_text(path)
    found = F.transform(
        F.array(text),
        lambda t: F.struct(*[
            key_from_path(t, v, defaults.get(k), ignore_case).alias(k) for k, v in vocabularies.items()
        ]),
    )

    def complete(s: Column) -> Column:
        ok = F.lit(True)
        for k in required:
            ok = ok & s[k].isNotNull()
        return ok

    return F.try_element_at(F.filter(found, complete), F.lit(1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def name_parts(name: Column, suffix: str = ".tsv") -> dict[str, Column]:
    """task, model and action from a ``task_model_..._action`` file name."""
    parts = F.split(F.regexp_replace(name, rf"\Q{suffix}\E\z", ""), "_")
    return {
        "task": F.element_at(parts, 1),
        "model": F.try_element_at(parts, F.lit(2)),
        "action": F.element_at(parts, -1),
    }
