"""Literal object graphs as entries rows.

Values: str = name, bytes = string, int/float = number, bool, None = null,
Ref = reference, dict, list, Stream(dict).
"""

from __future__ import annotations

from dataclasses import dataclass

from quire import schemas


@dataclass(frozen=True)
class Ref:
    to: str


@dataclass(frozen=True)
class Stream:
    d: dict


def _rows(doc, oid, value, path):
    key = path[-1] if path else None
    idx = int(key[1:-1]) if key and key.startswith("[") else None

    def row(vt, raw=None, shown=None, num=None, ref=None):
        node = "ref" if ref else vt if vt in ("dict", "array", "stream") else "scalar"
        return (doc, oid, list(path), list(path[:-1]), key, idx, node, vt, raw, shown if shown is not None else raw, num, ref)

    if isinstance(value, Stream):
        yield row("stream")
        value = value.d
    elif isinstance(value, dict):
        yield row("dict")
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _rows(doc, oid, v, [*path, k])
    elif isinstance(value, list):
        yield row("array")
        for i, v in enumerate(value):
            yield from _rows(doc, oid, v, [*path, f"[{i}]"])
    elif isinstance(value, Ref):
        yield row("reference", value.to, ref=value.to)
    elif value is None:
        yield row("null", "null")
    elif isinstance(value, bool):
        yield row("boolean", str(value).lower())
    elif isinstance(value, (int, float)):
        yield row("number", str(value), num=float(value))
    elif isinstance(value, bytes):
        text = value.decode()
        yield row("string", f"({text})", text)
    else:
        yield row("name", f"/{value}", value)


def entries_frame(spark, objects):
    rows = [r for (doc, oid), v in objects.items() for r in _rows(doc, oid, v, [])]
    return spark.createDataFrame(rows, schemas.ENTRIES)


def sort_rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
