"""Tables with nulls, blanks, repeated rows and extra columns, or without rows."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

EXTRA = ["id", "tab", "cls", "copy", "look", "raw_", "n", "s", "fields", "use", "label_", "_t", "x"]


def write(src: str, out: Path, rows: bool) -> str:
    """A copy of the tables at ``src``: with ``rows``, a fifth of the values of every column is null and some rows come twice; else empty."""
    rng = np.random.default_rng(6)
    for p in sorted(Path(src).glob("*.parquet")):
        t = pq.read_table(p)
        n = t.num_rows if rows else 0
        t = t.slice(0, n)
        cols = {}
        for name in t.column_names:
            c = t.column(name).combine_chunks()
            if rows:
                hit = pa.array(rng.random(n) < 0.2)
                c = pa.compute.if_else(hit, pa.scalar(None, c.type), c)
                if pa.types.is_string(c.type):
                    c = pa.compute.if_else(pa.array(rng.random(n) < 0.05), pa.scalar("", c.type), c)
                    c = pa.compute.if_else(pa.array(rng.random(n) < 0.05), pa.scalar(" \t", c.type), c)
            cols[name] = c
        for e in EXTRA:
            if e not in cols:
                cols[e] = pa.array([1] * n, pa.int32())
        t = pa.table(cols)
        if rows:
            t = pa.concat_tables([t, t.slice(0, n // 4)])
        pq.write_table(t, out / p.name)
    return str(out)
