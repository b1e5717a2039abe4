"""The same answers as plain SQL, written independently of the library.

Rank statistics number every row of a group here, crosstabs count each cell
with a filter, and density sums are a join of weights and mesh points.
"""

from __future__ import annotations

RAW = """
calendar AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderdate,
         CAST((month(o_orderdate) + 8) % 12 AS INTEGER) AS m,
         CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 4 THEN 1 ELSE 0 END
              AS INTEGER) AS y
  FROM orders),
raw AS (
  SELECT o_orderkey AS Row_ID, c_custkey AS unique_id, m + 1 AS Month_idx,
         substr('AprMayJunJulAugSepOctNovDecJanFebMar', m * 3 + 1, 3) AS Month,
         'Q' || CAST(m // 3 + 1 AS VARCHAR) AS Financial_Quarter,
         CAST(y AS VARCHAR) || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0')
           AS Financial_Year,
         CAST(y AS VARCHAR) || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0')
           || ' Q' || CAST(m // 3 + 1 AS VARCHAR) AS Year_Quarter,
         substr('MonTueWedThuFriSatSun', CAST(isodow(o_orderdate) - 1 AS INTEGER) * 3 + 1, 3)
           AS DOTW,
         CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 'Other'
              ELSE c_mktsegment END AS Demographic_Segment,
         o_orderpriority AS Demographic_Priority, o_orderstatus AS Demographic_Status,
         r_name AS Demographic_Region, n_name AS Demographic_Nation,
         o_totalprice AS Num_Price, c_acctbal AS Num_Balance,
         CASE WHEN o_orderkey % 10 = 0 THEN 0.0::DOUBLE WHEN o_orderkey % 17 = 0 THEN NULL
              ELSE o_totalprice END AS Num_Score
  FROM calendar JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

IMPUTED = """,
imputed AS (
  SELECT raw.* REPLACE (coalesce(Num_Score, avg_score) AS Num_Score)
  FROM raw JOIN (SELECT Demographic_Priority AS p, avg(Num_Score) AS avg_score
                 FROM raw GROUP BY 1) ON p = Demographic_Priority)"""

KEPT = """,
kept AS (SELECT * FROM raw WHERE Demographic_Region IN ('ASIA', 'EUROPE'))"""

LINES = """
calendar AS (
  SELECT *, CAST((month(l_shipdate) + 8) % 12 AS INTEGER) AS m,
         CAST(year(l_shipdate) - CASE WHEN month(l_shipdate) < 4 THEN 1 ELSE 0 END
              AS INTEGER) AS y
  FROM lineitem),
lines AS (
  SELECT substr('AprMayJunJulAugSepOctNovDecJanFebMar', m * 3 + 1, 3) AS Month,
         'Q' || CAST(m // 3 + 1 AS VARCHAR) AS Financial_Quarter,
         CAST(y AS VARCHAR) || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0')
           AS Financial_Year,
         l_returnflag AS Demographic_ReturnFlag, l_quantity AS Num_Quantity,
         l_extendedprice AS Num_ExtPrice, l_tax AS Num_Tax
  FROM calendar JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

NUMBERED = """
calendar AS (
  SELECT *, CAST((month(l_shipdate) + 8) % 12 AS INTEGER) AS m,
         CAST(year(l_shipdate) - CASE WHEN month(l_shipdate) < 4 THEN 1 ELSE 0 END
              AS INTEGER) AS y
  FROM lineitem),
numbered AS (
  SELECT substr('AprMayJunJulAugSepOctNovDecJanFebMar', m * 3 + 1, 3) AS Month,
         CAST(y AS VARCHAR) || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0')
           AS Financial_Year,
         CAST(l_linenumber AS VARCHAR) AS Demographic_Line,
         CAST(l_orderkey AS VARCHAR) AS Demographic_Order,
         l_quantity AS Num_Quantity, l_tax AS Num_Tax
  FROM calendar)"""

Q, M, YQ, FY = "Financial_Quarter", "Month", "Year_Quarter", "Financial_Year"
SEG, STATUS, PRIO = "Demographic_Segment", "Demographic_Status", "Demographic_Priority"
REGION, NATION, FLAG = "Demographic_Region", "Demographic_Nation", "Demographic_ReturnFlag"
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "Other", None]
STATUSES = ["F", "O", "P"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
MONTH_LIST = "['Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec','Jan','Feb','Mar']"
DAY_LIST = "['Mon','Tue','Wed','Thu','Fri','Sat','Sun']"


def rnd(expr: str, digits: int = 2) -> str:
    """Half-even rounding of a value first settled at eight decimals."""
    return f"CAST(round_even(CAST({expr} AS DECIMAL(28,8)), {digits}) AS DOUBLE)"


def shown(g: str) -> str:
    return f"({g} IS NOT NULL AND NOT regexp_matches({g}, '(?i)NA|Other'))"


def shown_strict(g: str) -> str:
    return f"({g} IS NOT NULL AND NOT regexp_matches({g}, '(?i)^(na|other.*)$'))"


MEAN = f"{rnd('avg(x)')} AS mean"
MEDIAN = f"{rnd('CASE WHEN count(*) = count(x) THEN median(x) END')} AS median"
_KEEP = "rn > floor(nn * 0.2::DOUBLE) AND rn <= nn - floor(nn * 0.2::DOUBLE)"


def trimmed(name: str = "trimmed_mean_20") -> str:
    return f"{rnd(f'avg(x) FILTER (WHERE {_KEEP})')} AS {name}"


ROWS = "count(*) AS n"
SUMMARY = (MEAN, MEDIAN, trimmed(), ROWS)
LINE = (trimmed("mean"), MEDIAN, ROWS)
PLAIN = (MEAN, MEDIAN, ROWS)


def stats(src: str, keys: list[str], x: str, aggs, where: str = "TRUE") -> str:
    k = ", ".join(keys)
    return f"""SELECT {k}, {", ".join(aggs)} FROM (
      SELECT {k}, {x} AS x,
             row_number() OVER (PARTITION BY {k} ORDER BY {x} NULLS LAST) AS rn,
             count({x}) OVER (PARTITION BY {k}) AS nn
      FROM {src} WHERE {where}) GROUP BY {k}"""


def counts(src: str, keys: list[str], where: str = "TRUE") -> str:
    k = ", ".join(keys)
    return f"SELECT {k}, count(*) AS n FROM {src} WHERE {where} GROUP BY {k}"


def on_grid(src: str, keys: list[str], levels_of: str = "raw", nulls: bool = True) -> str:
    """Counts of every level combination; null joins in where it occurs."""
    grids = []
    for k in keys:
        known = f"SELECT DISTINCT {k} FROM {levels_of} WHERE {k} IS NOT NULL"
        if nulls:
            known += f" UNION SELECT {k} FROM {src} WHERE {k} IS NULL"
        grids.append(f"({known})")
    match = " AND ".join(f"s.{k} IS NOT DISTINCT FROM g.{k}" for k in keys)
    cols = ", ".join(f"g.{k}" for k in keys)
    return f"""SELECT {cols}, count(s.hit) AS n
      FROM (SELECT * FROM {" CROSS JOIN ".join(grids)}) g
      LEFT JOIN (SELECT *, 1 AS hit FROM {src}) s ON {match} GROUP BY {cols}"""


def wide(src, rows, col, levels, percent=True, names=str, suffix="_percent", band=False) -> str:
    r = ", ".join(rows)

    def cell(v):
        where = f"{col} IS NULL" if v is None else f"{col} = '{v}'"
        return f"CAST(coalesce(sum(n) FILTER (WHERE {where}), 0) AS BIGINT)"

    def name(v):
        return names("null" if v is None else v)

    out = []
    if percent:
        for v in levels:
            pct = rnd(f"100.0::DOUBLE * {cell(v)} / nullif(sum(n), 0)")
            out.append(f'{pct} AS "{name(v)}{suffix}"')
    out += [f'{cell(v)} AS "{name(v)}"' for v in levels]
    if band:
        out += [f'{bands(cell(v))} AS "{name(v)}_band"' for v in levels]
    return f"SELECT {r}, {', '.join(out)} FROM ({on_grid(src, [*rows, col])}) GROUP BY {r}"


def bands(n: str) -> str:
    return f"CASE WHEN {n} <= 100 THEN 'low' WHEN {n} <= 300 THEN 'medium' ELSE 'high' END"


def with_(body: str, *ctes: str) -> str:
    return f"WITH {''.join(ctes) or RAW}\n{body}"


def freq(src: str, keys: list[str], levels_of: str = "raw") -> str:
    k = ", ".join(keys)
    return f"SELECT {k}, n AS freq FROM ({on_grid(src, keys, levels_of, nulls=False)})"


def r_label(v: str) -> str:
    """R's name for the priority labels, the only ones used that it changes."""
    return "X" + v.replace("-", ".").replace(" ", ".")


SUMMARY_2 = stats("raw", [Q, SEG], "Num_Score", SUMMARY, "Num_Score <> 0")
AREA = stats("raw", [YQ, SEG], "Num_Score", PLAIN, shown(SEG))


def share(group: str, time: str = YQ, fill: bool = False, visible=shown, src: str = "raw") -> str:
    total = "sum(cell) OVER (PARTITION BY t)"
    if not fill:
        total = f"CASE WHEN count(cell) OVER (PARTITION BY t) = count(*) OVER (PARTITION BY t) \
THEN {total} END"
    cell = "coalesce(cell, 0)" if fill else "cell"
    return f"""SELECT t AS Time, c AS Condition,
        {rnd(f"100.0::DOUBLE * {cell} / n")} AS Percentage, CAST(n AS BIGINT) AS n FROM (
      SELECT t, c, cell, {total} AS n FROM (
        SELECT t, c, cell FROM (SELECT DISTINCT {time} AS t FROM {src} WHERE {visible(group)})
        CROSS JOIN (SELECT DISTINCT {group} AS c FROM {src} WHERE {visible(group)})
        LEFT JOIN (SELECT {time} AS t2, {group} AS c2, count(*) AS cell FROM {src}
                   GROUP BY 1, 2) ON t = t2 AND c = c2))"""


def sample() -> str:
    return """SELECT Row_ID, Demographic_Segment, Num_Balance, Num_Score FROM raw
      WHERE Demographic_Segment IS NOT NULL AND Num_Balance IS NOT NULL
        AND Num_Score IS NOT NULL
      ORDER BY md5('42:' || CAST(Row_ID AS VARCHAR)), Row_ID LIMIT 1000"""


def trimmed_rows(src: str, group: str, x: str) -> str:
    year = f"{src} WHERE Financial_Year = '1998-99' AND {x} > 0"
    return f"""SELECT Financial_Year, {group}, {x} FROM {year}
      AND {x} BETWEEN (SELECT quantile_cont({x}, 0.05) FROM {year})
                  AND (SELECT quantile_cont({x}, 0.95) FROM {year})"""


def bandwidth(src: str, group: str, x: str) -> str:
    return f"""SELECT {group}, n, sd, q25, q75,
        0.9::DOUBLE * coalesce(nullif(least(sd, (q75 - q25) / 1.34::DOUBLE), 0), nullif(sd, 0),
                       nullif(abs(first_x), 0), 1) * pow(n, -0.2::DOUBLE) AS h
      FROM (SELECT {group}, count(*) AS n, stddev_samp({x}) AS sd, min({x}) AS first_x,
                   quantile_cont({x}, 0.25) AS q25, quantile_cont({x}, 0.75) AS q75
            FROM ({trimmed_rows(src, group, x)}) GROUP BY {group}) WHERE n >= 2"""


def curve(src: str, group: str, x: str) -> str:
    return f""",
rows_ AS ({trimmed_rows(src, group, x)}),
mesh AS (
  SELECT {group} AS g, n, h, lo, hi, lo - 4 * h AS start,
         (hi - lo + 8 * h) / 511 AS step
  FROM ({bandwidth(src, group, x)}), (SELECT min({x}) AS lo, max({x}) AS hi FROM rows_)),
placed AS (
  SELECT g, ({x} - start) / step AS pos FROM rows_ JOIN mesh ON {group} IS NOT DISTINCT FROM g),
weights AS (
  SELECT g, j, sum(w) AS w FROM (
    SELECT g, CAST(floor(pos) AS INTEGER) AS j, 1 - (pos - floor(pos)) AS w FROM placed
    UNION ALL
    SELECT g, CAST(floor(pos) AS INTEGER) + 1, pos - floor(pos) FROM placed) GROUP BY 1, 2),
knots AS (
  SELECT m.g, i, sum(w * exp(-0.5::DOUBLE * ((i - j) * step / h) ** 2))
                 / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS d
  FROM mesh m JOIN weights w ON m.g IS NOT DISTINCT FROM w.g
  CROSS JOIN range(0, 512) AS r(i) GROUP BY 1, 2),
points AS (
  SELECT g, k AS point, lo + k * (hi - lo) / 511 AS px,
         (lo + k * (hi - lo) / 511 - start) / step AS pos
  FROM mesh CROSS JOIN range(0, 512) AS r(k))
SELECT p.g AS {group}, CAST(point AS INTEGER) AS point, {rnd("px", 4)} AS x,
       {rnd("1e6 * (a.d + (pos - floor(pos)) * (coalesce(b.d, 0) - a.d))", 4)} AS density_e6
FROM points p
JOIN knots a ON a.g IS NOT DISTINCT FROM p.g AND a.i = CAST(floor(pos) AS INTEGER)
LEFT JOIN knots b ON b.g IS NOT DISTINCT FROM p.g AND b.i = CAST(floor(pos) AS INTEGER) + 1"""


def roles() -> str:
    listed = (
        [("time", c) for c in (M, Q, "DOTW", FY, YQ)]
        + [("group", c) for c in (SEG, PRIO, STATUS, REGION, NATION)]
        + [("measure", c) for c in ("Num_Price", "Num_Balance", "Num_Score")]
    )
    size = {"time": 5, "group": 5, "measure": 3}
    seen: dict[str, int] = {}
    rows = []
    for role, c in listed:
        i = seen[role] = seen.get(role, 0) + 1
        rows.append(
            f"SELECT '{c}' AS column_name, '{role}' AS role, {i} AS ordinal, "
            f"{size[role] - i + 1} AS reverse_ordinal, {role == 'group'} AS in_area, "
            f"{role != 'measure'} AS filterable, (SELECT count({c}) FROM raw) AS filled_rows"
        )
    return " UNION ALL ".join(rows)


def level_rows() -> str:
    order = {
        M: f"list_position({MONTH_LIST}, level)",
        "DOTW": f"list_position({DAY_LIST}, level)",
    }
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS dimension,
          CAST(row_number() OVER (ORDER BY {order.get(c, 'level')}) AS INTEGER) AS level_idx,
          level, n
        FROM (SELECT {c} AS level, count(*) AS n FROM raw WHERE {c} IS NOT NULL GROUP BY 1)"""
        for c in (M, Q, "DOTW", FY, YQ, SEG, PRIO, STATUS, REGION, NATION)
    )


def numeric_level_rows() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS dimension,
          CAST(row_number() OVER (ORDER BY CAST(level AS BIGINT)) AS INTEGER) AS level_idx,
          level, n
        FROM (SELECT {c} AS level, count(*) AS n FROM numbered GROUP BY 1)"""
        for c in ("Demographic_Line", "Demographic_Order")
    )


def compare(keys: list[str], measures: list[str]) -> str:
    k = "".join(f"{c}, " for c in keys)
    long = " UNION ALL ".join(
        f"SELECT '{v}' AS variant, '{m}' AS measure, {k}{m} AS x FROM {t}"
        for v, t in (("raw", "raw"), ("imputed", "imputed"))
        for m in measures
    )

    def side(v: str) -> str:
        w = f"FILTER (WHERE variant = '{v}')"
        nulls = f"(count(*) {w} - count(x) {w})"
        return f"""count(*) {w} AS {v}_rows, {nulls} AS {v}_nulls,
          {rnd(f"100.0::DOUBLE * {nulls} / count(*) {w}")} AS {v}_null_percent,
          {rnd(f"avg(x) {w}")} AS {v}_mean, {rnd(f"median(x) {w}")} AS {v}_median"""

    def change(f: str) -> str:
        imputed, raw = (f"{f}(x) FILTER (WHERE variant = '{v}')" for v in ("imputed", "raw"))
        return rnd(f"{imputed} - {raw}")

    return f"""SELECT measure, {k}{side("raw")}, {side("imputed")},
        {change("avg")} AS mean_change, {change("median")} AS median_change
      FROM ({long}) GROUP BY measure{"".join(f", {c}" for c in keys)}"""


def both_levels() -> str:
    fine = stats("raw", [Q, SEG], "Num_Score", (MEDIAN, ROWS), "Num_Score > 0")
    coarse = stats("raw", [Q], "Num_Score", (MEDIAN, ROWS), "Num_Score > 0")
    return f"""SELECT {Q}, {SEG}, 0 AS level, median, n FROM ({fine}) UNION ALL
      SELECT {Q}, NULL AS {SEG}, 1 AS level, median, n FROM ({coarse})"""


def grouped_and_overall(src: str, time: str, group: str, x: str) -> str:
    part = stats(src, [time, group], x, LINE, f"{x} > 0 AND {shown(group)}")
    whole = stats(src, [time], x, LINE, f"{x} > 0")
    return f"""SELECT {time}, {group}, mean, median, n FROM ({part}) UNION ALL
      SELECT {time}, 'All' AS {group}, mean, median, n FROM ({whole})"""


def filtered_and_all(time: str, x: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{x}: {label}' AS category, * FROM ({stats(src, [time], x, LINE, f'{x} > 0')})"
        for label, src in (("Filtered", "kept"), ("All", "raw"))
    )


def long_percent() -> str:
    return f"""SELECT {Q}, coalesce({SEG}, 'null') || '_percent' AS Condition,
        {rnd(f"100.0::DOUBLE * n / sum(n) OVER (PARTITION BY {Q})")} AS Percentage
      FROM ({on_grid("raw", [Q, SEG])})"""


def stacked() -> str:
    area = stats("raw", [YQ, SEG], "Num_Price", PLAIN, shown(SEG))
    run = f"sum(mean) OVER (PARTITION BY {YQ} ORDER BY {SEG} DESC ROWS UNBOUNDED PRECEDING)"
    return f"""SELECT {YQ}, {SEG}, mean, median, n, {rnd(run)} AS ymax,
        {rnd(f"{run} - mean")} AS ymin FROM ({area})"""


def stacked_bars() -> str:
    where = f"Num_Score > 0 AND {Q} = 'Q4' AND {shown(SEG)} AND {shown(STATUS)}"
    bars = stats("raw", [Q, SEG, STATUS], "Num_Score", PLAIN, where)
    run = f"sum(mean) OVER (PARTITION BY {SEG} ORDER BY {STATUS} DESC ROWS UNBOUNDED PRECEDING)"
    return f"""SELECT {Q}, {SEG}, {STATUS}, mean, median, n, {rnd(run)} AS ymax,
        {rnd(f"{run} - mean")} AS ymin FROM ({bars})"""


ROLE_COLUMNS = f"Row_ID, {SEG}, {STATUS}, Num_Balance, Num_Score"

ORACLE_SQL = {
    "load_dataset": with_(
        f"SELECT * REPLACE ({rnd('Num_Price')} AS Num_Price, {rnd('Num_Balance')} AS Num_Balance,"
        f" {rnd('Num_Score')} AS Num_Score) FROM imputed",
        RAW, IMPUTED,
    ),
    "load_dataset_raw": with_("SELECT * FROM raw"),
    "cohort_filter": with_("SELECT * FROM kept", RAW, KEPT),
    "export_csv": with_(SUMMARY_2),
    "dataset_by_year": with_(
        stats("raw", [M, PRIO], "Num_Score", SUMMARY, f"Num_Score <> 0 AND {FY} = '1998-99'")
    ),
    "catalog_roles": with_(roles()),
    "level_values": with_(level_rows()),
    "levels_after_change": with_(
        on_grid("changed", [SEG, PRIO, STATUS], levels_of="changed"),
        RAW,
        f""",
changed AS (SELECT * REPLACE (CASE WHEN Row_ID % 3 = 1 AND {SEG} = 'BUILDING' THEN 'Houses' ELSE {SEG} END AS {SEG})
            FROM raw)""",
    ),
    "level_values_numeric": with_(numeric_level_rows(), NUMBERED),
    "export_csv_rows": """SELECT row_number() OVER (ORDER BY l_partkey) AS row, l_partkey,
        CASE l_partkey % 5 WHEN 0 THEN 'say "part ' || l_partkey || '", twice'
          WHEN 1 THEN 'part ' || l_partkey || chr(10) || 'second line' WHEN 3 THEN 'NA'
          WHEN 4 THEN '  part ' || l_partkey END AS label, n
      FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)""",
    "summary_many_labels": with_(
        stats(
            "numbered", [FY, "Demographic_Order"], "Num_Quantity", SUMMARY, "Num_Quantity <> 0"
        ),
        NUMBERED,
    ),
    "summary_mixed_groups": with_(
        stats("mixed", ["Demographic_Order"], "Num_Quantity", SUMMARY, "Num_Quantity <> 0"),
        NUMBERED,
        """,
mixed AS (SELECT * REPLACE (CASE WHEN CAST(Demographic_Order AS BIGINT) % 3 = 0 THEN '0'
                            ELSE Demographic_Order END AS Demographic_Order) FROM numbered)""",
    ),
    "year_recode": with_(
        f"""SELECT CAST(dense_rank() OVER (ORDER BY {FY}) + 2018 AS INTEGER) AS Year, {FY}, n
        FROM ({counts("raw", [FY])})"""
    ),
    "fiscal_dims": """SELECT o_orderkey, o_orderdate,
        CAST(m + 1 AS INTEGER) AS Month_idx,
        substr('AprMayJunJulAugSepOctNovDecJanFebMar', m * 3 + 1, 3) AS Month,
        'Q' || (m // 3 + 1) AS Financial_Quarter,
        y || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS Financial_Year,
        y || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') || ' Q' || (m // 3 + 1)
          AS Year_Quarter,
        left(dayname(o_orderdate), 3) AS DOTW
      FROM (SELECT *, CAST((month(o_orderdate) + 8) % 12 AS INTEGER) AS m,
                   year(o_orderdate) - CAST(month(o_orderdate) < 4 AS INTEGER) AS y
            FROM orders)""",
    "filter_nonzero": with_(
        f"SELECT {ROLE_COLUMNS} FROM raw WHERE Num_Balance <> 0 AND Num_Score <> 0"
    ),
    "filter_positive": with_(
        f"SELECT {ROLE_COLUMNS} FROM raw WHERE Num_Balance > 0 AND Num_Score > 0"
    ),
    "filter_labels": with_(f"SELECT {ROLE_COLUMNS} FROM raw WHERE {shown(SEG)}"),
    "filter_labels_strict": with_(
        f"SELECT {ROLE_COLUMNS}, {NATION} FROM raw "
        f"WHERE {shown_strict(SEG)} AND {shown_strict(NATION)}"
    ),
    "scatter_complete": with_(
        f"SELECT Row_ID, {SEG}, Num_Balance, Num_Score FROM raw "
        f"WHERE {SEG} IS NOT NULL AND Num_Balance IS NOT NULL AND Num_Score IS NOT NULL"
    ),
    "freq_table": with_(freq("raw", [Q, SEG])),
    "freq_table_filtered": with_(freq("kept", [M, REGION]), RAW, KEPT),
    "reliability_band": with_(
        f"SELECT *, {bands('freq')} AS band FROM ({freq('raw', [M, SEG])})"
    ),
    "reliability_band_crosstab": with_(wide("raw", [M], STATUS, STATUSES, band=True)),
    "group_count_1": with_(counts("raw", [Q])),
    "group_count_2": with_(counts("raw", [Q, SEG])),
    "group_count_3": with_(counts("raw", [Q, SEG, STATUS])),
    "complete_grid": with_(on_grid("kept", [YQ, SEG, REGION]), RAW, KEPT),
    "row_percent_long": with_(
        f"SELECT *, {rnd(f'100.0::DOUBLE * n / nullif(sum(n) OVER (PARTITION BY {Q}), 0)')} "
        f"AS percent FROM ({on_grid('raw', [Q, SEG])})"
    ),
    "pivot_counts": with_(wide("raw", [Q], SEG, SEGMENTS, percent=False)),
    "crosstab_1": with_(wide("raw", [Q], SEG, SEGMENTS)),
    "crosstab_1_filtered": with_(wide("kept", ["DOTW"], REGION, REGIONS), RAW, KEPT),
    "crosstab_1_r_names": with_(
        wide("raw", [FY], PRIO, PRIORITIES, names=r_label, suffix=".Percent")
    ),
    "crosstab_2": with_(wide("raw", [Q, SEG], STATUS, STATUSES)),
    "crosstab_2_cube": with_(wide("kept", [Q, SEG], STATUS, STATUSES), RAW, KEPT),
    "quantiles_sketched": with_(
        f"""SELECT {Q}, {SEG}, p, count(*) AS n, TRUE AS within
        FROM kept, unnest([0.05::DOUBLE, 0.5::DOUBLE, 0.95::DOUBLE]) AS u(p) WHERE Num_Score > 0 GROUP BY ALL""",
        RAW,
        KEPT,
    ),
    "summary_1": with_(stats("raw", [M], "Num_Score", SUMMARY, "Num_Score <> 0")),
    "summary_2": with_(SUMMARY_2),
    "summary_signed": with_(stats("raw", [Q, SEG], "Num_Balance", SUMMARY)),
    "summary_imputed": with_(
        stats("imputed", [FY, PRIO], "Num_Score", SUMMARY, "Num_Score <> 0"), RAW, IMPUTED
    ),
    "summary_ranked": with_(SUMMARY_2),
    "summary_lines": with_(
        stats("lines", [M, FLAG], "Num_Quantity", SUMMARY, "Num_Quantity <> 0"), LINES
    ),
    "summary_lines_ranked": with_(
        stats("lines", [FY, FLAG], "Num_ExtPrice", SUMMARY, "Num_ExtPrice <> 0"), LINES
    ),
    "median_strict": with_(stats("raw", [Q, SEG], "Num_Score", (MEDIAN, ROWS))),
    "trimmed_mean": with_(stats("lines", [Q, FLAG], "Num_ExtPrice", (trimmed(), ROWS)), LINES),
    "trimmed_mean_bucketed": with_(
        stats("lines", [Q, FLAG], "Num_ExtPrice", (trimmed(), ROWS)), LINES
    ),
    "ordered_summary": with_(stats("raw", [M, SEG], "Num_Balance", SUMMARY, "Num_Balance <> 0")),
    "trend_1": with_(stats("raw", [M], "Num_Score", LINE, "Num_Score > 0")),
    "trend_filtered_vs_all": with_(filtered_and_all(Q, "Num_Score"), RAW, KEPT),
    "trend_filtered_vs_all_ranked": with_(filtered_and_all(M, "Num_Balance"), RAW, KEPT),
    "trend_groups_overall": with_(grouped_and_overall("raw", Q, SEG, "Num_Score")),
    "trend_groups_overall_numeric": with_(
        grouped_and_overall("numbered", M, "Demographic_Line", "Num_Tax"), NUMBERED
    ),
    "stacked_share": with_(
        f"""SELECT Time, Condition, Percentage, n, {rnd("top")} AS ymax,
          {rnd("top - coalesce(Percentage, 0)")} AS ymin
        FROM (SELECT *, sum(Percentage) OVER (PARTITION BY Time ORDER BY Condition DESC
                ROWS UNBOUNDED PRECEDING) AS top
              FROM ({share(SEG, fill=True)}))"""
    ),
    "trend_groups_overall_ranked": with_(grouped_and_overall("lines", M, FLAG, "Num_Tax"), LINES),
    "grouping_sets_median": with_(both_levels()),
    "latest_bar_1": with_(
        stats("raw", [Q, SEG], "Num_Score", PLAIN, f"Num_Score > 0 AND {Q} = 'Q4' AND {shown(SEG)}")
    ),
    "latest_bar_2": with_(
        stats(
            "raw", [M, SEG, STATUS], "Num_Score", PLAIN,
            f"Num_Score > 0 AND {M} = 'Mar' AND {shown(SEG)} AND {shown(STATUS)}",
        )
    ),
    "area_mean": with_(AREA),
    "area_mean_positive": with_(
        stats("raw", [YQ, SEG], "Num_Score", PLAIN, f"Num_Score > 0 AND {shown(SEG)}")
    ),
    "share_area": with_(share(SEG)),
    "share_area_filled": with_(share(SEG, fill=True)),
    "share_area_hidden": with_(share(NATION)),
    "share_area_year": with_(
        share(SEG, "Year", src="dated"),
        RAW,
        f""",
dated AS (SELECT *, CAST(dense_rank() OVER (ORDER BY {FY}) + 2018 AS INTEGER) AS Year FROM raw)""",
    ),
    "share_area_r_names": with_(
        f"""SELECT Time, 'X' || replace(replace(Condition, '-', '.'), ' ', '.') AS Condition,
          Percentage, n FROM ({share(PRIO, visible=shown_strict)})"""
    ),
    "unpivot_share": with_(long_percent()),
    "stacked_layout": with_(stacked()),
    "stacked_bars": with_(stacked_bars()),
    "scatter_sample": with_(sample()),
    "scatter_sample_stored": with_(sample()),
    "linear_trend": with_(
        f"""SELECT {SEG}, {rnd("slope", 6)} AS slope, {rnd("icept", 6)} AS intercept, n,
          {rnd("x_min", 6)} AS x_min, {rnd("x_max", 6)} AS x_max,
          {rnd("icept + slope * x_min", 6)} AS fit_min,
          {rnd("icept + slope * x_max", 6)} AS fit_max
        FROM (SELECT {SEG}, regr_slope(Num_Score, Num_Balance) AS slope,
                regr_intercept(Num_Score, Num_Balance) AS icept,
                CAST(regr_count(Num_Score, Num_Balance) AS BIGINT) AS n,
                min(Num_Balance) AS x_min, max(Num_Balance) AS x_max
              FROM ({sample()}) GROUP BY {SEG})"""
    ),
    "density_trim": with_(trimmed_rows("raw", SEG, "Num_Score")),
    "density_bandwidth": with_(
        f"""SELECT {STATUS}, n, {rnd("sd", 4)} AS sd, {rnd("q25", 4)} AS q25,
          {rnd("q75", 4)} AS q75, {rnd("h", 4)} AS h
        FROM ({bandwidth("raw", STATUS, "Num_Score")})"""
    ),
    "density_curve": with_(curve("raw", STATUS, "Num_Score"), RAW),
    "density_curve_lines_ranked": with_(curve("lines", FLAG, "Num_ExtPrice"), LINES),
    "grid_filter": with_(
        f"""SELECT * FROM ({stats("raw", [M, SEG], "Num_Score", SUMMARY, "Num_Score <> 0")})
        WHERE n >= 100 AND {SEG} IN ('BUILDING', 'MACHINERY', 'Other')
          AND contains(lower({M}), 'a')"""
    ),
    "grid_search": with_(f"SELECT * FROM ({SUMMARY_2}) WHERE contains(lower({SEG}), 'build')"),
    "grid_page": with_(
        f"SELECT * FROM ({SUMMARY_2}) ORDER BY {Q}, {SEG} NULLS LAST LIMIT 10 OFFSET 10"
    ),
    "grid_page_stored": with_(
        f"""SELECT Row_ID, {SEG}, {STATUS}, Num_Balance, Num_Score FROM raw
        ORDER BY Num_Score DESC NULLS LAST, Row_ID LIMIT 40 OFFSET 1440"""
    ),
    "top_k": with_(
        f"SELECT * FROM ({counts('raw', [YQ, SEG])}) "
        f"ORDER BY n DESC, {YQ}, {SEG} NULLS FIRST LIMIT 10"
    ),
    "imputation_compare": with_(
        compare([], ["Num_Price", "Num_Balance", "Num_Score"]), RAW, IMPUTED
    ),
    "imputation_rows": with_(
        " UNION ALL ".join(
            f"""SELECT '{m}' AS measure, count(*) AS n, 0::BIGINT AS raw_only, 0::BIGINT AS imputed_only,
              count(*) FILTER (r.{m} IS NULL AND i.{m} IS NOT NULL) AS filled, count(*) FILTER (i.{m} IS NULL) AS missing,
              count(*) FILTER (r.{m} <> i.{m}) AS changed,
              {rnd(f"avg(i.{m}) FILTER (r.{m} IS NULL)")} AS filled_mean,
              {rnd(f"stddev_samp(i.{m}) FILTER (r.{m} IS NULL)")} AS filled_sd,
              {rnd(f"avg(i.{m}) FILTER (r.{m} IS NOT NULL)")} AS observed_mean,
              {rnd(f"stddev_samp(i.{m}) FILTER (r.{m} IS NOT NULL)")} AS observed_sd
            FROM raw r JOIN imputed i USING (Row_ID)"""
            for m in ("Num_Price", "Num_Balance", "Num_Score")
        ),
        RAW,
        IMPUTED,
    ),
    "imputation_compare_by_group": with_(compare([PRIO], ["Num_Score"]), RAW, IMPUTED),
}

for _name in ("quantile_band", "quantile_band_ranked"):
    ORACLE_SQL[_name] = with_(
        f"""SELECT {FY}, {rnd("quantile_cont(Num_Score, 0.05)")} AS p05,
          {rnd("quantile_cont(Num_Score, 0.95)")} AS p95
        FROM raw WHERE Num_Score > 0 GROUP BY {FY}"""
    )
