"""Building blocks of the SQL that checks the queries: named table expressions for DuckDB."""

from __future__ import annotations

TREE = """tree AS (
  SELECT n_regionkey::BIGINT * 16 AS s, 1::BIGINT AS p, n_nationkey::BIGINT * 16 + 1 AS o FROM nation
  UNION ALL SELECT c_nationkey::BIGINT * 16 + 1, 2, c_custkey * 16 + 2 FROM customer
  UNION ALL SELECT s_nationkey::BIGINT * 16 + 1, 3, s_suppkey * 16 + 3 FROM supplier
  UNION ALL SELECT o_custkey * 16 + 2, 4, o_orderkey * 16 + 4 FROM orders
  UNION ALL SELECT l_orderkey * 16 + 4, 5, l_suppkey * 16 + 3 FROM lineitem)"""

REVERSE = """rev AS (
  SELECT o_orderkey * 16 + 4 AS s, 4::BIGINT AS p, o_custkey * 16 + 2 AS o FROM orders
  UNION ALL SELECT c_custkey * 16 + 2, 2, c_nationkey::BIGINT * 16 + 1 FROM customer
  UNION ALL SELECT n_nationkey::BIGINT * 16 + 1, 1, n_regionkey::BIGINT * 16 FROM nation)"""

MIX = """mix AS (
  SELECT o_custkey * 16 + 2 AS s, 4::BIGINT AS p, o_orderkey * 16 + 4 AS o FROM orders
  UNION ALL SELECT l_orderkey * 16 + 4, 6, l_partkey * 16 + 5 FROM lineitem)"""

CYCLE = """kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS v FROM (SELECT DISTINCT event_type FROM events)),
follows AS (SELECT DISTINCT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events),
cyc AS (SELECT a.v::BIGINT AS s, 1::BIGINT AS p, b.v::BIGINT AS o FROM follows f JOIN kinds a USING (event_type) JOIN kinds b ON b.event_type = f.nxt)"""

TYPES = """named AS (
  SELECT c_custkey * 16 + 2 AS s, 'segment ' || c_mktsegment AS c FROM customer
  UNION ALL SELECT o_orderkey * 16 + 4, 'priority ' || o_orderpriority FROM orders),
types AS (SELECT s, 0::BIGINT AS p, ((dense_rank() OVER (ORDER BY c) - 1) * 16 + 15)::BIGINT AS o FROM named)"""

PART_TYPES = """pnamed AS (SELECT p_partkey * 16 + 5 AS s, concat_ws('|', p_brand, p_type, p_size::VARCHAR) AS c FROM part),
ptypes AS (SELECT s, 0::BIGINT AS p, ((dense_rank() OVER (ORDER BY c) - 1) * 16 + 15)::BIGINT AS o FROM pnamed)"""


def starts(of: str, name: str = "vs") -> str:
    """Start sets of an acyclic triple table, as (v, st)."""
    return f"""{name}_e AS (SELECT DISTINCT s, o FROM {of}),
{name}_s AS (SELECT DISTINCT s FROM {of} WHERE s NOT IN (SELECT o FROM {of})),
{name} AS (SELECT s AS v, s AS st FROM {name}_s UNION SELECT e.o, r.st FROM {name} r JOIN {name}_e e ON e.s = r.v)"""


def weight(of: str, name: str, alpha: float, rounds: int, back: bool = False, normalised: bool = False) -> str:
    """(v, w) after the rounds, one table expression for each."""
    a, b = ("o", "s") if back else ("s", "o")
    x = "sum(w.w) / sqrt(sum(w.w * w.w))" if normalised else "sum(w.w)"
    parts = [f"{name}0 AS (SELECT DISTINCT v, 1.0::DOUBLE AS w FROM (SELECT s AS v FROM {of} UNION ALL SELECT o FROM {of}))"]
    for k in range(rounds):
        parts.append(f"""{name}{k + 1} AS (SELECT w.v, coalesce(1::DOUBLE - {alpha}::DOUBLE + {alpha}::DOUBLE * g.x, w.w) AS w FROM {name}{k} w
  LEFT JOIN (SELECT e.{b} AS v, {x} AS x FROM {of} e JOIN {name}{k} w ON w.v = e.{a} GROUP BY 1) g ON g.v = w.v)""")
    return ",\n".join([*parts, f"{name} AS (SELECT * FROM {name}{rounds})"])


def product(of: str, name: str, alpha: float, rounds: int) -> str:
    return f"""{weight(of, name + "_i", alpha, rounds)},
{weight(of, name + "_o", alpha, rounds, back=True)},
{name} AS (SELECT i.v, i.w AS w_in, o.w AS w_out, i.w * o.w AS w FROM {name}_i i JOIN {name}_o o USING (v))"""


_TOUCHED = "list_distinct(list_transform(r.t, lambda i: {labels}[i]))"


def fold(sets: str, weights: str, k: int, name: str) -> str:
    """Groups by merging in order of weight: {name}(st, grp)."""
    touched = _TOUCHED.format(labels="f.labels")
    return f"""{name}_i AS MATERIALIZED (SELECT st, row_number() OVER (ORDER BY st) AS i FROM (SELECT DISTINCT st FROM {sets})),
{name}_a AS (SELECT v, list_sort(list(i)) AS t FROM {sets} JOIN {name}_i USING (st) GROUP BY v HAVING count(*) > 1),
{name}_d AS (SELECT t, min((-w, v)) AS pos FROM {name}_a JOIN {weights} USING (v) GROUP BY t),
{name}_r AS MATERIALIZED (SELECT t, row_number() OVER (ORDER BY pos) AS n FROM {name}_d),
{name}_f AS (
  SELECT 0::BIGINT AS n, (SELECT list(i ORDER BY i) FROM {name}_i) AS labels, (SELECT ceil(count(*) / {k}::DOUBLE) FROM {name}_i) AS cap
  UNION ALL
  SELECT n, CASE WHEN len(list_filter(labels, lambda x: list_contains(c, x))) <= cap
      THEN list_transform(labels, lambda x: CASE WHEN list_contains(c, x) THEN list_min(c) ELSE x END) ELSE labels END, cap
  FROM (SELECT r.n, f.labels, f.cap, {touched} AS c FROM {name}_f f JOIN {name}_r r ON r.n = f.n + 1)),
{name}_l AS (SELECT unnest(labels) AS g, unnest(range(1, len(labels) + 1)) AS i FROM (SELECT labels FROM {name}_f ORDER BY n DESC LIMIT 1)),
{name} AS (SELECT a.st, b.st AS grp FROM {name}_l l JOIN {name}_i a ON a.i = l.i JOIN {name}_i b ON b.i = l.g)"""


def packed(groups: str, k: int, name: str, loads: str | None = None) -> str:
    """Groups on partitions: {name}(st, part); ``loads`` gives the list of what they hold already."""
    first = loads or "[" + ", ".join("0::BIGINT" for _ in range(k)) + "]"
    return f"""{name}_z AS (SELECT grp, count(*) AS c FROM {groups} GROUP BY grp),
{name}_r AS MATERIALIZED (SELECT grp, c, row_number() OVER (ORDER BY c DESC, grp) AS n FROM {name}_z),
{name}_f AS (
  SELECT 0::BIGINT AS n, -1::BIGINT AS grp, -1::BIGINT AS part, {first} AS loads
  UNION ALL
  SELECT n, grp, best - 1, list_transform(loads, lambda x, i: CASE WHEN i = best THEN x + c ELSE x END)
  FROM (SELECT r.n, r.grp, r.c, f.loads, list_position(f.loads, list_min(f.loads))::BIGINT AS best FROM {name}_f f JOIN {name}_r r ON r.n = f.n + 1)),
{name} AS (SELECT g.st, f.part::INTEGER AS part FROM {groups} g JOIN {name}_f f USING (grp))"""


def placed(of: str, name: str, k: int, alpha: float, rounds: int) -> str:
    """From a triple table to {name}_vp(v, part) and {name}(part, s, p, o)."""
    return f"""{starts(of, name + "_vs")},
{product(of, name + "_w", alpha, rounds)},
{fold(name + "_vs", name + "_w", k, name + "_g")},
{packed(name + "_g", k, name + "_p")},
{name}_vp AS (SELECT DISTINCT v, part FROM {name}_vs JOIN {name}_p USING (st)),
{name} AS (SELECT part, s, p, o FROM {of} JOIN {name}_vp ON v = s)"""


def regrouped(old: str, later: str, k: int, name: str) -> str:
    """Groups and partitions kept up through batch 0: from ``placed`` tables {old}_* and the new triples to {name}_vp(v, part)."""
    held = lambda p: f"list_sum(list_transform(range(1, len(labels) + 1), lambda i: CASE WHEN list_contains(c, labels[i]) AND parts[labels[i]] = {p} THEN sizes[i] ELSE 0 END))"
    return f"""{starts(later, name + "_vs")},
{name}_alive AS (SELECT DISTINCT st FROM {name}_vs),
{name}_old AS (SELECT st, grp, part, false AS new FROM {old}_g JOIN {old}_p USING (st) SEMI JOIN {name}_alive USING (st)),
{name}_lone AS (SELECT v AS st, min(part) AS part FROM {old}_vp GROUP BY v HAVING count(*) = 1),
{name}_held AS (SELECT * FROM {name}_old UNION ALL SELECT a.st, a.st, coalesce(l.part, -1), true FROM (SELECT st FROM {name}_alive ANTI JOIN {name}_old USING (st)) a LEFT JOIN {name}_lone l ON l.st = a.st),
{name}_named AS (SELECT grp, new, part, min(st) AS name, count(*) AS n FROM {name}_held GROUP BY ALL),
{name}_known AS (SELECT h.st, m.name, m.n, m.part FROM {name}_held h JOIN {name}_named m USING (grp, new, part)),
{name}_i AS MATERIALIZED (SELECT name, n, part, row_number() OVER (ORDER BY name) AS i FROM {name}_named),
{name}_t AS (SELECT v, list_sort(list(DISTINCT i)) AS t FROM {name}_vs JOIN {name}_known USING (st) JOIN {name}_i USING (name) WHERE v IN (SELECT o FROM inserted WHERE batch = 0) GROUP BY v HAVING count(DISTINCT i) > 1),
{name}_r AS MATERIALIZED (SELECT t, row_number() OVER (ORDER BY v) AS n FROM {name}_t),
{name}_f AS (
  SELECT 0::BIGINT AS n, (SELECT list(i ORDER BY i) FROM {name}_i) AS labels, (SELECT list(part::BIGINT ORDER BY i) FROM {name}_i) AS parts, (SELECT list(n ORDER BY i) FROM {name}_i) AS sizes, (SELECT ceil(count(*) / {k}::DOUBLE) FROM {name}_alive) AS cap
  UNION ALL
  SELECT n, CASE WHEN fits THEN list_transform(labels, lambda x: CASE WHEN list_contains(c, x) THEN list_min(c) ELSE x END) ELSE labels END,
    CASE WHEN fits AND len(c) > 1 THEN list_transform(parts, lambda x, i: CASE WHEN i = list_min(c) THEN CASE WHEN list_max(h) > 0 THEN list_position(h, list_max(h)) - 1 ELSE -1 END ELSE x END) ELSE parts END, sizes, cap
  FROM (SELECT *, list_sum(list_transform(sizes, lambda x, i: CASE WHEN list_contains(c, labels[i]) THEN x ELSE 0 END)) <= cap AS fits, [{", ".join(held(p) for p in range(k))}] AS h
    FROM (SELECT r.n, f.labels, f.parts, f.sizes, f.cap, {_TOUCHED.format(labels="f.labels")} AS c FROM {name}_f f JOIN {name}_r r ON r.n = f.n + 1))),
{name}_l AS (SELECT unnest(range(1, len(labels) + 1)) AS i, unnest(labels) AS l, unnest(list_transform(labels, lambda x: parts[x])) AS part FROM (SELECT labels, parts FROM {name}_f ORDER BY n DESC LIMIT 1)),
{name}_g AS (SELECT k.st, min(k.st) OVER (PARTITION BY l.l) AS grp, l.part FROM {name}_known k JOIN {name}_i USING (name) JOIN {name}_l l USING (i)),
{name}_u AS (SELECT st, grp FROM {name}_g WHERE part < 0),
{packed(name + "_u", k, name + "_q", f"(SELECT list(c ORDER BY p) FROM (SELECT r.p, count(g.st) AS c FROM range({k}) r(p) LEFT JOIN {name}_g g ON g.part = r.p GROUP BY r.p))")},
{name}_p AS (SELECT st, part::INTEGER AS part FROM {name}_g WHERE part >= 0 UNION ALL SELECT st, part FROM {name}_q),
{name}_vp AS (SELECT DISTINCT v, part FROM {name}_vs JOIN {name}_p USING (st))"""


def pools(of: str, insert_share: float, delete_share: float, batches: int, buckets: int) -> str:
    """first, inserted, deleted and batches over the hash buckets of a triple table."""
    ins, dele = round(insert_share * batches * buckets), buckets - round(delete_share * batches * buckets)
    return f"""dealt AS (SELECT s, p, o, (s * 31 + p * 17 + o) % {buckets} AS h FROM {of}),
inserted AS (SELECT (h % {batches})::INTEGER AS batch, s, p, o FROM dealt WHERE h < {ins}),
first AS (SELECT s, p, o FROM dealt WHERE h >= {ins}),
deleted AS (SELECT (h % {batches})::INTEGER AS batch, s, p, o FROM dealt WHERE h >= {max(ins, dele)})"""


def after(base: str, batch: int, name: str) -> str:
    return f"""{name} AS (SELECT s, p, o FROM {base} t WHERE NOT EXISTS (SELECT 1 FROM deleted d WHERE d.batch = {batch} AND d.s = t.s AND d.p = t.p AND d.o = t.o)
  UNION ALL SELECT s, p, o FROM inserted WHERE batch = {batch})"""


def with_all(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select
