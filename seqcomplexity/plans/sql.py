"""DuckDB SQL of the measures, built from their definitions: recursive queries that take one symbol at a time."""

from __future__ import annotations


def _zero(source: str) -> str:
    return f"SELECT id, CASE WHEN s = '' THEN '0' ELSE s END AS s FROM ({source})"


def _reverse(source: str) -> str:
    return f"SELECT id, array_to_string(list_reverse(string_split(s, '')), '') AS s FROM ({source})"


def lz76(source: str, tag: str = "") -> str:
    """Common table expressions ending in ``c76{tag}(id, n, phrases)`` for a source of ``id, s``."""
    return f"""
    src{tag} AS MATERIALIZED ({source}),
    run{tag}(id, j, start, closed) AS (
      SELECT id, 1, 1, 0 FROM src{tag}
      UNION ALL
      SELECT id, j + 1, CASE WHEN still THEN start ELSE j + 1 END, closed + CASE WHEN still THEN 0 ELSE 1 END
      FROM (SELECT r.*, strpos(substring(s, 1, j - 1), substring(s, start, j - start + 1)) > 0 AS still FROM run{tag} r JOIN src{tag} USING (id) WHERE j <= length(s))
    ),
    c76{tag} AS (SELECT r.id, length(s) AS n, closed + CASE WHEN start <= length(s) THEN 1 ELSE 0 END AS phrases FROM run{tag} r JOIN src{tag} USING (id) WHERE j = length(s) + 1)"""


def lz78(source: str, tag: str = "") -> str:
    """Common table expressions ending in ``c78{tag}(id, n, phrases)``."""
    return f"""
    src78{tag} AS MATERIALIZED ({source}),
    run78{tag}(id, j, start, known) AS (
      SELECT id, 1, 1, CAST([] AS VARCHAR[]) FROM src78{tag}
      UNION ALL
      SELECT id, j + 1, CASE WHEN has THEN start ELSE j + 1 END, CASE WHEN has THEN known ELSE list_append(known, word) END
      FROM (SELECT *, list_contains(known, word) AS has FROM (SELECT r.*, substring(s, start, j - start + 1) AS word FROM run78{tag} r JOIN src78{tag} USING (id) WHERE j <= length(s)))
    ),
    c78{tag} AS (SELECT r.id, length(s) AS n, len(known) + CASE WHEN start <= length(s) THEN 1 ELSE 0 END AS phrases, known, CASE WHEN start <= length(s) THEN substring(s, start) END AS open
      FROM run78{tag} r JOIN src78{tag} USING (id) WHERE j = length(s) + 1)"""


def measure(source: str, key: str, name: str, algorithm: str, symmetric: bool = False) -> str:
    cte, table, value = (lz76, "c76", "{t}.phrases * log2({t}.n)") if algorithm == "lz76" else (lz78, "c78", "CAST({t}.phrases AS DOUBLE)")
    if not symmetric:
        return f"WITH RECURSIVE {cte(_zero(source))} SELECT id AS {key}, round({value.format(t=table)}, 6) + 0.0 AS {name} FROM {table}"
    return (
        f"WITH RECURSIVE {cte(_zero(source), '_f')}, {cte(_reverse(_zero(source)), '_b')} "
        f"SELECT id AS {key}, round(({value.format(t=table + '_f')} + {value.format(t=table + '_b')}) / 2, 6) + 0.0 AS {name} FROM {table}_f JOIN {table}_b USING (id)"
    )


def conditional(pairs: str, key: str, name: str, algorithm: str) -> str:
    """For a source of ``id, x, y``."""
    zero = f"SELECT id, CASE WHEN x = '' THEN '0' ELSE x END AS x, CASE WHEN y = '' THEN '0' ELSE y END AS y FROM ({pairs})"
    cte, table, value = (lz76, "c76", "{t}.phrases * log2({t}.n)") if algorithm == "lz76" else (lz78, "c78", "CAST({t}.phrases AS DOUBLE)")
    return (
        f"WITH RECURSIVE {cte(f'SELECT id, x || y AS s FROM ({zero})', '_xy')}, {cte(f'SELECT id, x AS s FROM ({zero})', '_x')} "
        f"SELECT id AS {key}, round({value.format(t=table + '_xy')} - {value.format(t=table + '_x')}, 6) + 0.0 AS {name} FROM {table}_xy JOIN {table}_x USING (id)"
    )


def conditional_identity(pairs: str, key: str, name: str, algorithm: str) -> str:
    """``conditional`` where an empty x gives y's own complexity and an empty y gives 0."""
    cte, table, value = (lz76, "c76", "{t}.phrases * log2(greatest({t}.n, 1))") if algorithm == "lz76" else (lz78, "c78", "CAST({t}.phrases AS DOUBLE)")
    return (
        f"WITH RECURSIVE {cte(f'SELECT id, x || y AS s FROM ({pairs})', '_xy')}, {cte(f'SELECT id, x AS s FROM ({pairs})', '_x')} SELECT id AS {key}, "
        f"round(CASE WHEN {table}_xy.n = {table}_x.n THEN 0 ELSE {value.format(t=table + '_xy')} - {value.format(t=table + '_x')} END, 6) + 0.0 AS {name} FROM {table}_xy JOIN {table}_x USING (id)"
    )


def block_counts(source: str, k: int) -> str:
    return f"SELECT id, substring(s, i, {k}) AS block, count(*) AS n FROM (SELECT id, s, unnest(range(1, length(s) - {k} + 2)) AS i FROM ({source})) GROUP BY ALL"


def block_entropy(source: str, key: str, name: str, k: int) -> str:
    return (
        f"WITH src AS ({_zero(source)}), c AS ({block_counts('SELECT * FROM src', k)}), e AS (SELECT id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM c GROUP BY id) "
        f"SELECT src.id AS {key}, round(coalesce(h, 0), 6) + 0.0 AS {name} FROM src LEFT JOIN e USING (id)"
    )


def exhaustive(length: int) -> str:
    """Common table expressions ending in ``counts(bits, phrases)``."""
    return f"""
    r(bits, start, closed) AS (
      SELECT '', 1, 0
      UNION ALL
      SELECT bits, CASE WHEN still THEN start ELSE length(bits) + 1 END, closed + CASE WHEN still THEN 0 ELSE 1 END
      FROM (SELECT bits, start, closed, strpos(substring(bits, 1, length(bits) - 1), substring(bits, start)) > 0 AS still FROM (SELECT bits || b AS bits, start, closed FROM r, (VALUES ('0'), ('1')) v(b) WHERE length(bits) < {length}))
    ),
    counts AS (SELECT bits, CAST(closed + CASE WHEN start <= {length} THEN 1 ELSE 0 END AS INTEGER) AS phrases FROM r WHERE length(bits) = {length})"""


def distribution(length: int, bins: int) -> str:
    return (
        f"WITH RECURSIVE {exhaustive(length)} SELECT CAST(b.i AS INTEGER) AS complexity, count(phrases) AS n_strings "
        f"FROM range({bins}) b(i) LEFT JOIN counts ON least(phrases, {bins - 1}) = b.i GROUP BY b.i"
    )
