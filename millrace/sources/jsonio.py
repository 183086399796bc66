"""JSON access with strict types, on the driver and in columns; whole files; paths of suites."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import to_uint


#: Messages that callers match, of a member's place.
REQUIRED, MUST_BE, BAD_JSON, BAD_FILE = "{} is required.", "{} must be {}.", "Could not parse JSON file: {}: {}", "Could not open file: {}"
AN_OBJECT, AN_ARRAY, A_STRING, A_BOOLEAN, A_SIZE, A_NUMBER = "an object", "an array", "a string", "a boolean", "a non-negative integer", "a number"


def load_json_file(path: str | Path) -> object:
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise ValueError(BAD_JSON.format(path, e)) from e


def member_context(context: str, key: str) -> str:
    return f"{context}.{key}" if context else key


def find_member(record: Mapping, key: str) -> object | None:
    return record.get(key)


def require_member(record: Mapping, key: str, context: str = "") -> object:
    if key not in record:
        raise ValueError(REQUIRED.format(member_context(context, key)))
    return record[key]


def _strict(test: Callable[[object], bool], what: str) -> Callable[[object, str], object]:
    def check(value: object, context: str) -> object:
        if not test(value):
            raise ValueError(MUST_BE.format(context, what))
        return value

    return check


_whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
as_object = _strict(lambda v: isinstance(v, dict), AN_OBJECT)
as_array = _strict(lambda v: isinstance(v, list), AN_ARRAY)
as_string = _strict(lambda v: isinstance(v, str), A_STRING)
as_bool = _strict(lambda v: isinstance(v, bool), A_BOOLEAN)
as_size = _strict(lambda v: _whole(v) and 0 <= v < 2**64, A_SIZE)  # type: ignore[operator]


def as_uint(value: object, context: str) -> int:
    size = as_size(value, context)
    try:
        return to_uint(size)  # type: ignore[arg-type]
    except OverflowError:
        raise ValueError(MUST_BE.format(context, "below 2^32")) from None


def as_double(value: object, context: str) -> float:
    """A number, or the string NaN."""
    if value == "NaN":
        return float("nan")
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(MUST_BE.format(context, A_NUMBER))
    return float(value)


def find_as(record: Mapping, key: str, how: Callable[[object, str], object], context: str = "") -> object | None:
    """A member by one of the checks above; None if it isn't there."""
    return how(record[key], member_context(context, key)) if key in record else None


def member(c: Column, key: str) -> Column:
    """A member of a JSON text as text; null if it isn't there."""
    return F.get_json_object(c, f"$.{key}")


def required_member(c: Column, key: str, context: str = "") -> Column:
    return F.coalesce(member(c, key), F.raise_error(F.lit(REQUIRED.format(member_context(context, key)))).cast("string"))


def double_member(c: Column, key: str) -> Column:
    """A number or the string NaN as a double; null for anything else."""
    return F.when(member(c, key) == "NaN", F.lit(float("nan"))).otherwise(F.try_variant_get(F.try_parse_json(c), f"$.{key}", "double"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON files, one document a file."""
    return spark.read.json(path, multiLine=True)


def read_file(path: str | Path) -> bytes:
    try:
        return Path(path).read_bytes()
    except OSError as e:
        raise OSError(BAD_FILE.format(path)) from e


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def resolve_path(root: str | Path, *parts: str) -> Path:
    return Path(root).joinpath(*parts)


def root_path(*parts: str) -> Path:
    """A path below the folder that holds this package."""
    return resolve_path(Path(__file__).resolve().parents[2], *parts)


def data_path(*parts: str) -> Path:
    return root_path("data", *parts)


def benchmarks_path(*parts: str) -> Path:
    return root_path("benchmarks", *parts)


def suite_path(suite: Mapping, root: str | Path, key: str) -> Path:
    """A suite's member path below its optional prefix."""
    prefix = find_as(suite, "prefix", as_string) or ""
    return resolve_path(root, str(prefix), str(as_string(require_member(suite, key), key)))
