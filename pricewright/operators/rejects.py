"""Rows that fail to parse, told apart by DuckDB's CSV reader on the workers.

Each Arrow batch is written, per delimiter and field count, to a file in
memory (one record a line, its number in front, a closing mark behind, so that
surplus empty fields show) and read by DuckDB in strict mode with reject
tables. The line-level errors are joined to the raw records by line; the
accepted rows come back typed. A record that opens a quotation without closing
it would swallow its neighbours, so such records get a file each. The reader's
quoting errors stand as they are; as it lets some stray quotes pass and may
report a count of fields first, an exact check of the quoting rule follows for
whatever it accepted or called columns. Nothing is shuffled; memory is one batch.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from pricewright.runtime import arrow_map

# Stand-ins for characters that would end a line of the file.
_OUT_OF_LINE = {ord("\n"): "\ufdd0", ord("\r"): "\ufdd1", 0: "\ufdd2"}
_BACK = {"\ufdd0": "\n", "\ufdd1": "\r", "\ufdd2": "\0"}
_BLANK = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*"
_DASH = r"[-\x{2010}-\x{2015}\x{2212}\x{FE58}\x{FE63}\x{FF0D}]"
_PRICE = r"\$?" + _BLANK + r"(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\.[0-9]{2})?"
# Fixed value: what every line of a file ends with.
_CLOSING = "\ufdd3"
#: Files open at once while single records are read.
_AT_ONCE = 200


@lru_cache(maxsize=64)
def _well_formed(delimiter: str):
    d = re.escape(delimiter)
    field = rf'(?:"(?:[^"]|"")*"|[^"{d}\r\n]*)'
    return re.compile(rf"{field}(?:{d}{field})*").fullmatch


@lru_cache(maxsize=64)
def _left_open(delimiter: str):
    """Matches records that end inside a quotation, as the reader sees them."""
    d = re.escape(delimiter)
    quoted, bare = '"(?:[^"]|"")*+', rf'(?:[^"{d}][^{d}]*+)?'
    return re.compile(rf'(?:(?:{quoted}"|{bare}){d})*+{quoted}').fullmatch


def quoting_holds(data: str, delimiter: str) -> bool:
    """Whether every field with the delimiter, a quote or a line break stands in
    double quotes from its first to its last character, inner quotes doubled."""
    return _well_formed(delimiter)(data) is not None


class _File:
    """A file in memory that DuckDB can open by name."""

    def __init__(self, text: str) -> None:
        self.fd = os.memfd_create("rows")
        data = memoryview(text.encode("utf-8", "surrogatepass"))
        while data:
            data = data[os.write(self.fd, data) :]

    @property
    def path(self) -> str:
        return f"/proc/{os.getpid()}/fd/{self.fd}"

    def close(self) -> None:
        os.close(self.fd)


def _scan(con, files: list[_File], delimiter: str, cols: int, longest: int, select: str) -> tuple[list[tuple], list[tuple]]:
    """Accepted rows, and (file, line, error type) of the rejected ones."""
    names = ", ".join(["'n': 'BIGINT'", *(f"'c{i}': 'VARCHAR'" for i in range(cols)), "'closing': 'VARCHAR'"])
    con.execute("DROP TABLE IF EXISTS reject_errors; DROP TABLE IF EXISTS reject_scans")
    size = max(2_000_000, 8 * longest)
    paths = ", ".join(f"'{f.path}'" for f in files)
    rows = con.execute(
        f"SELECT {select} FROM read_csv([{paths}], header=false, auto_detect=false, delim=$d, quote='\"', escape='\"', new_line='\\n', strict_mode=true, "
        f"columns={{{names}}}, store_rejects=true, rejects_limit=0, null_padding=false, parallel=false, max_line_size={size}, buffer_size={4 * size})".replace("$d", "'" + delimiter.replace("'", "''") + "'")
    ).fetchall()
    errors = con.execute("SELECT s.file_path, e.line, e.error_type FROM reject_errors e JOIN reject_scans s USING (scan_id, file_id)").fetchall()
    return rows, errors


def _select(cols: int, typed: bool) -> str:
    ok = [f"NOT regexp_full_match(coalesce(c0, ''), '{_BLANK}')"]
    cells = []
    for i in range(1, cols):
        ok.append(f"regexp_full_match(coalesce(c{i}, ''), '{_BLANK}(?:{_DASH}|{_PRICE})?{_BLANK}')")
        cells.append(f"TRY_CAST(regexp_replace(c{i}, '[^0-9.]', '', 'g') AS DECIMAL(18,2))")
    return f"n, {' AND '.join(ok)}" + (f", c0, [{', '.join(cells)}]::DECIMAL(18,2)[]" if typed else ", NULL, NULL")


def _connect():
    import duckdb

    # No temp_directory: what doesn't fit in memory fails, it isn't spilled to a worker's disk.
    return duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})


def _line(k: int, delimiter: str, data: str) -> str:
    if "\n" in data or "\r" in data or "\0" in data:
        data = data.translate(_OUT_OF_LINE)
    return f"{k}{delimiter}{data}{delimiter}{_CLOSING}\n"


def parse_records(batch: list[tuple[int, int | None, str | None, str | None]], con, typed: bool = True) -> list[tuple]:
    """(record_id, reason, model, prices) for records (record_id, cols, delimiter, data)."""
    out: list[tuple] = []
    groups: dict[tuple[str, int], list[tuple[int, str]]] = {}
    for rid, cols, delimiter, data in batch:
        data = data or ""
        if not delimiter or len(delimiter) != 1 or delimiter in '"\r\n\0' or not cols or cols < 1:
            out.append((rid, "columns", None, None))
        else:
            groups.setdefault((delimiter, cols), []).append((rid, data))
    for (delimiter, cols), records in groups.items():
        is_open = _left_open(delimiter)
        lines = [_line(k, delimiter, data) for k, (_, data) in enumerate(records)]
        longest = max(map(len, lines))
        apart = [k for k, (_, data) in enumerate(records) if '"' in data and is_open(data)]
        alone = set(apart)
        reads = [[[k for k in range(len(records)) if k not in alone]]] if len(apart) < len(records) else []
        reads += [[[k] for k in apart[i : i + _AT_ONCE]] for i in range(0, len(apart), _AT_ONCE)]
        rows: dict[int, tuple] = {}
        errors: dict[int, str] = {}
        for parts in reads:
            files = [_File("".join(lines[k] for k in part)) for part in parts]
            try:
                found, bad = _scan(con, files, delimiter, cols, longest, _select(cols, typed))
                of = {f.path: part for f, part in zip(files, parts)}
                for n, *row in found:
                    rows[n] = row
                for path, line, kind in bad:
                    k = of[path][min(line, len(of[path])) - 1]
                    errors[k] = "quoting" if "COLUMNS" not in kind or errors.get(k) == "quoting" else "columns"
            finally:
                for f in files:
                    f.close()
        formed = _well_formed(delimiter)
        for k, (rid, data) in enumerate(records):
            reason = errors.get(k) or (None if k in rows else "columns")
            if reason != "quoting" and formed(data) is None:
                reason = "quoting"
            if reason:
                out.append((rid, reason, None, None))
            else:
                ok, model, prices = rows[k]
                out.append((rid, None, "".join(_BACK.get(c, c) for c in model or "").strip(), prices) if ok else (rid, "value", None, None))
    return out


def parse_numbers(batch: list[tuple[int, str | None]], con, digits: int) -> list[tuple]:
    """(record_id, reason, number) for texts that should hold a number of up to so many digits."""
    if not batch:
        return []
    texts = [(t or "").strip().translate(_OUT_OF_LINE).replace('"', '""') for _, t in batch]
    f = _File("".join(f'{k},"{t}",{_CLOSING}\n' for k, t in enumerate(texts)))
    try:
        rows, errors = _scan(con, [f], ",", 1, max(map(len, texts)) + 32, "n, TRY_CAST(c0 AS INTEGER), c0")
    finally:
        f.close()
    rejected = {line - 1 for _, line, _ in errors}
    exact = re.compile(rf"[0-9]{{1,{digits}}}").fullmatch
    value = {n: v for n, v, raw in rows if v is not None and exact(raw or "")}
    return [(rid, None, value[k]) if k in value and k not in rejected else (rid, "value", None) for k, (rid, _) in enumerate(batch)]


def _records(typed: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        con = _connect()
        for b in batches:
            found = parse_records(list(zip(*(c.to_pylist() for c in b.columns))), con, typed)
            cols = list(zip(*found)) or [()] * 4
            kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.decimal128(18, 2)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["record_id", "reason", "model", "prices"])

    return run


def _numbers(digits: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        con = _connect()
        for b in batches:
            cols = list(zip(*parse_numbers(list(zip(*(c.to_pylist() for c in b.columns))), con, digits))) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int32()))], names=["record_id", "reason", "number"])

    return run


def load_delimited(df: DataFrame, key: str = "line_id", cols: str = "cols", delimiter: str = "delimiter", data: str = "data", typed: bool = True) -> DataFrame:
    """(record_id, reason, model, prices): every record, with the reason it can't
    be loaded (quoting, else columns, else value) or its typed fields.

    Null data counts as one empty field; a null or unusable delimiter or count
    is reason columns. Each input row gives one row, repeats included. Not
    typed: reasons only, model and prices stay empty."""
    d = arrow_map(df.select(key, cols, delimiter, data), _records(typed), "record_id bigint, reason string, model string, prices array<decimal(18,2)>")
    return d if typed else d.select("record_id", "reason")


def load_numbers(df: DataFrame, key: str, field: str, digits: int = 4) -> DataFrame:
    """(record_id, reason, number): every record, with reason value where the
    text, blanks around aside, isn't one to `digits` digits. Null is not."""
    return arrow_map(df.select(key, field), _numbers(digits), "record_id bigint, reason string, number int")
