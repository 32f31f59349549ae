"""Chart specs against a plain reading, one spec at a time."""

import random
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import pytest

from docloom.operators import rewrites as R
from docloom.operators import specs as S
from docloom.operators.visual import FALLBACK, LIMITS
from docloom.plans import spec_queries as Q

SF = "/root/testdata/sf0.001"


def parts(ref):
    table, colon, key = ref.partition(":")
    return (table, key) if colon and table and key else (None, None)


def shown(rows, r):
    twice = r["section"] and sum(x["label"] == r["label"] for x in rows) > 1
    return (f"{r['label']} ({r['section']})" if twice else r["label"]) or r["key"]


class Plain:
    def __init__(self, tables, rows, columns, cells):
        self.tables = {t["table"]: t for t in tables}
        self.rows = {t: sorted((r for r in rows if r["table"] == t), key=lambda r: r["idx"]) for t in self.tables}
        self.columns = {t: sorted((c for c in columns if c["table"] == t), key=lambda c: c["idx"]) for t in self.tables}
        self.cells = {(c["table"], c["row"], c["col"]): c for c in cells}

    def x_axis(self, table, key):
        t = self.tables[table]
        if key in ("columns", "column_headers"):
            return "row"
        if key in ("rows", "row_labels", t["label_key"]):
            return "col"
        return ("col" if t["period_axis"] == "rows" else "row") if key in ("period", "periods") else None

    def candidates(self, table, axis, kind, chosen):
        """(label, key, period, granularity, end, own_period), in order, and the measure that was chosen for all."""
        measure = None
        if axis == "row":
            items = [c for c in self.columns[table] if c["type"] in S.MEASURED and (not chosen or c["key"] in chosen)]
            measures = list(dict.fromkeys(c["measure"] for c in items if c["measure"]))
            if not chosen and len(measures) > 1:
                measure = measures[0]
                items = [c for c in items if c["measure"] == measure]
            out = [[c["period"] or c["label"], c["label"], c["key"], c["period"], c["granularity"], c["end"], c["period"]] for c in items]
        else:
            rows = self.rows[table]
            items = [r for r in rows if (r["type"] == "data" or (r["type"] == "total" and (kind == "table" or chosen))) and (not chosen or r["key"] in chosen)]
            own = lambda r: r["period"] if r["type"] == "data" else None
            out = [[own(r) or shown(rows, r), shown(rows, r), r["key"], own(r), r["granularity"], r["end"], r["period"]] for r in items]
        if len({o[0] for o in out}) < len(out):
            out = [[o[1], *o[1:]] for o in out]
        return [(o[0], *o[2:]) for o in out], measure

    def resolve(self, s):
        chosen, found = list(dict.fromkeys(s["tables"] or [])), []
        if found := [f"unknown table {t}" for t in chosen if t not in self.tables]:
            return found
        x_table, x_key = parts(s["x"]) if s["x"] else (None, None)
        if s["x"] and (x_table not in chosen or self.x_axis(x_table, x_key) is None):
            return [f"x is no axis {s['x']}"]
        series, kind = list(dict.fromkeys(s["series"] or [])), s["kind"]
        if not series:
            return ["no series"]
        lo_s, hi_s, lo_x, hi_x = LIMITS[kind]
        if len(s["series"]) > hi_s and kind != "kpi":
            found.append("too many series")
        picked, categories = {}, list(dict.fromkeys(s["categories"] or []))
        for c in categories:
            t, key = parts(c)
            if t is None:
                found.append(f"malformed {c}")
            elif t not in chosen:
                found.append(f"category of no table {c}")
            else:
                picked.setdefault(t, set()).add(key)
        axes, good = {}, []
        for ref in series:
            t, key = parts(ref)
            if t is None:
                found.append(f"malformed {ref}")
                continue
            if t not in chosen:
                found.append(f"series of no table {ref}")
                continue
            is_row = any(r["key"] == key and r["type"] != "section" for r in self.rows[t])
            is_col = any(c["key"] == key and c["type"] in S.MEASURED for c in self.columns[t])
            if x_table == t:
                axis = self.x_axis(t, x_key)
                if not (is_row if axis == "row" else is_col):
                    found.append(f"series not on the axis {ref}")
                    continue
            elif is_row and is_col:
                axis = "col" if self.tables[t]["period_axis"] == "rows" else "row"
            elif is_row or is_col:
                axis = "row" if is_row else "col"
            else:
                found.append(f"no row or measured column {ref}")
                continue
            if axes.setdefault(t, axis) != axis:
                found.append(f"rows and columns mixed {t}")
                continue
            on = {x["key"] for x in (self.columns if axis == "row" else self.rows)[t]}
            if bad := sorted(f"{t}:{k}" for k in picked.get(t, set()) - on):
                found.append(f"categories off the axis {', '.join(bad)}")
                continue
            items, measure = self.candidates(t, axis, kind, picked.get(t))
            base = next(x for x in (self.rows if axis == "row" else self.columns)[t] if x["key"] == key)
            label = (shown(self.rows[t], base) if axis == "row" else base["label"]) or key
            cell = lambda k, t=t, key=key, axis=axis: self.cells.get((t, key, k) if axis == "row" else (t, k, key))
            points = {i[0]: cell(i[1]) for i in items if cell(i[1])}
            good.append(SimpleNamespace(ref=ref, table=t, label=f"{label} · {measure}" if measure else label, items=items, points=points))
        if found:
            return found
        xs = {}
        for g in good:
            for label, key, period, granularity, end, own in g.items:
                xs.setdefault(label, SimpleNamespace(label=label, period=period, granularity=granularity, end=end, own=own, refs=set(), n=len(xs))).refs.add(f"{g.table}:{key}")
        items = list(xs.values())
        periodic = bool(items) and all(i.period for i in items)
        have = {x["period"] for t in chosen for x in self.rows[t] + self.columns[t]}
        if found := [f"no such period {p}" for p in s["periods"] or [] if p not in have]:
            return found
        if s["periods"] and periodic:
            items = [i for i in items if i.period in s["periods"]]
        elif s["periods"] and kind == "table" and any(i.own for i in items):
            items = [i for i in items if i.own in s["periods"]]
        elif periodic and not categories and kind != "table":
            most = Counter(i.granularity for i in items).most_common(1)[0][0]
            items = [i for i in items if i.granularity == most]
        place = lambda i: min((categories.index(r) for r in i.refs if r in categories), default=10**6)
        items.sort(key=lambda i: (i.end.toordinal(), i.n) if periodic else (place(i), i.n) if categories else (0, i.n))
        if not items:
            return ["no x left"]
        if len(items) > hi_x:
            if s["periods"] or categories:
                found.append("too many x")
            else:
                items = items[-hi_x:] if periodic else items[:hi_x]
        if len(items) < lo_x:
            found.append("too few x")
        labels, merged, mixed = [i.label for i in items], [], []
        for g in good:
            g.points = {x: p for x, p in g.points.items() if x in labels}
            units = list(dict.fromkeys(p["unit"] for p in g.points.values() if p["value"] is not None))
            if len(units) > 1 and kind != "table":
                mixed.append(f"mixed units {g.ref}")
            if units:
                first = min((labels.index(x), p["unit"]) for x, p in g.points.items() if p["value"] is not None)[1]
            g.unit, g.refs = first if units else None, [g.ref]
            other = next((m for m in merged if (m.label, m.unit) == (g.label, g.unit) and not set(m.points) & set(g.points) and m.table != g.table), None)
            if other:
                other.points |= g.points
                other.refs.append(g.ref)
            else:
                merged.append(g)
        found += mixed
        values = [p["value"] for m in merged for p in m.points.values() if p["value"] is not None]
        units = {m.unit or "no unit" for m in merged}
        tell = [
            (not values, "no numbers"), (len(merged) < lo_s, "too few series"), (kind in ("grouped_bar", "stacked_bar", "waterfall", "donut") and len(units) > 1, f"more than one unit {', '.join(sorted(units))}"),
            (kind in ("stacked_bar", "donut") and any(v < 0 for v in values), "negative values"), (kind in ("stacked_bar", "donut") and "ratio" in units, "ratios don't add"), (kind == "donut" and periodic, "a donut over periods"),
            (kind == "line" and not periodic, "a line without periods"), (kind == "comparison" and len(items) == 1 and len(merged) < 2, "nothing to compare"), (kind == "kpi" and len(s["series"]) > 6, "too many tiles"),
        ]
        found += [text for hit, text in tell if hit]
        refs, x_refs = {r for m in merged for r in m.refs}, set(labels) | {r for i in items for r in i.refs}
        found += [f"highlight of nothing shown {h}" for h in s["highlight"] or [] if h not in refs | x_refs]
        for c in s["calculations"] or []:
            if c["series"] not in refs:
                found.append(f"calculation of no series {c['series']}")
            elif c["other"] and c["other"] not in refs:
                found.append(f"calculation of no series {c['other']}")
            elif c["op"] == "ratio" and not c["other"]:
                found.append("ratio of nothing")
            else:
                found += [f"calculation at no x {x}" for x in (c["from"], c["to"]) if x and x not in x_refs]
        return found or (labels, [(m.label, m.unit, m.refs) for m in merged])


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def compare(spark, asked, tables):
    plain = Plain(*map(rows_of, tables))
    got = {r.spec: r for r in S.resolved(asked, tables).collect()}
    told = Counter()
    specs = rows_of(asked)
    assert set(got) == {s["spec"] for s in specs} and len(got) == len(specs)
    for s in specs:
        want, r = plain.resolve(s), got[s["spec"]]
        if isinstance(want, list):
            assert (r.problems, r.x) == (want, None), s
            told.update(" ".join(w for w in p.split() if ":" not in w)[:9] for p in want)
        else:
            assert (r.problems, r.x, [tuple(x) for x in r.series]) == ([], *want), s
            told["fine"] += 1
    return told


@pytest.mark.skipif(not Path(SF).exists(), reason="the tables aren't here")
def test_specs_over_the_printed_grids(spark):
    tables = Q.printed(spark, SF)
    told = compare(spark, Q.asked(tables), tables)
    assert told["fine"] > 60 and len(told) >= 18, told


def made(spark):
    """Tables with sections, labels that repeat, two measures a period, ratios, quarters beside years, and cells that are missing or null."""
    tables = [("A", "columns", "item"), ("B", "rows", "period"), ("C", None, "name"), ("E", None, None)]
    rows = [
        ("A", "debt", 1, "Borrowings", "data", None, None, None, "Current"), ("A", "debt_2", 2, "Borrowings", "data", None, None, None, "Other"), ("A", "s", 0, "Section", "section", None, None, None, ""), ("A", "margin", 3, "Margin", "data", None, None, None, ""),
        ("A", "blank", 4, "", "data", None, None, None, ""), ("C", "north", 1, "North", "data", None, None, None, ""), ("C", "south", 2, "South", "data", None, None, None, ""), ("C", "both", 3, "Total", "total", None, None, None, ""), ("C", "sales", 4, "sales", "data", None, None, None, ""),
        *[("B", f"q{i}", i, f"Q{i} FY24", "data", f"Q{i} FY24", "quarter", f"2023-{3 * i + 3:02}-30" if i < 4 else "2024-03-31", "") for i in (1, 2, 4)], ("B", "year", 5, "Full year FY24", "data", "FY24", "year", "2024-03-31", ""), ("B", "sum", 6, "Total FY24", "total", "FY24", "year", "2024-03-31", ""),
    ]
    columns = [
        ("A", "item", 0, "Item", "text", None, None, None, None), ("A", "rev24", 1, "Revenue FY24", "currency", "FY24", "year", "2024-03-31", "Revenue"), ("A", "rev23", 2, "Revenue FY23", "currency", "FY23", "year", "2023-03-31", "Revenue"), ("A", "ebit24", 3, "EBITDA FY24", "currency", "FY24", "year", "2024-03-31", "EBITDA"),
        ("B", "period", 0, "Period", "text", None, None, None, None), ("B", "sales", 1, "sales", "number", None, None, None, None), ("B", "share", 2, "Share", "percent", None, None, None, None), ("C", "sales", 1, "sales", "number", None, None, None, None), ("C", "sales_2", 2, "sales", "number", None, None, None, None), ("C", "note", 3, "Note", "text", None, None, None, None),
    ]
    cells = []
    for t in ("A", "B", "C"):
        for r in (r for r in rows if r[0] == t):
            for c in (c for c in columns if c[0] == t and c[4] != "text"):
                n = (len(r[1]) * 7 + len(c[1]) * 3) % 11
                if n != 4:
                    cells.append((t, r[1], c[1], None if n == 5 else float(n - 3), "ratio" if r[1] == "margin" else "INR" if n % 5 else "INR crore"))
    item = "table string, key string, idx int, label string, type string, period string, granularity string, end string"
    dated = lambda d: d.withColumn("end", d.end.cast("date"))
    return S.Tables(
        spark.createDataFrame(tables, "table string, period_axis string, label_key string"), dated(spark.createDataFrame(rows, f"{item}, section string")), dated(spark.createDataFrame(columns, f"{item}, measure string")), spark.createDataFrame(cells, "table string, row string, col string, value double, unit string"),
    )


def random_specs(spark, tables, seed, n):
    rng = random.Random(seed)
    keys = {t: [x["key"] for f in (tables.rows, tables.columns) for x in rows_of(f) if x["table"] == t] for t in "ABC"}
    ref = lambda t: rng.choice([f"{t}:{rng.choice(keys[t])}"] * 12 + ["bad", f"{t}:", "Z:q", f"{t}:none"])
    specs = []
    for i in range(n):
        t = rng.choice("ABC")
        use = [t] if rng.random() < 0.7 else [t, rng.choice("ABCE")]
        some = lambda most, chance: [ref(rng.choice([u for u in use if u in "ABC"])) for _ in range(rng.randrange(1, most))] if rng.random() < chance else []
        x = rng.choice([None] * 6 + [f"{t}:period", f"{t}:rows", f"{t}:columns", "bad", f"{t}:item"])
        calculation = (rng.choice(["growth", "ratio"]), ref(t), rng.choice([None, ref(t)]), rng.choice([None, "FY24", ref(t)]), None)
        specs.append((i, rng.choice([k for k in LIMITS if k != "timeline"]), use + ["Z"] * (rng.random() < 0.03), x, some(4, 0.97), rng.choice([[]] * 8 + [["FY24"], ["Q1 FY24", "Q2 FY24"], ["FY99"]]), some(3, 0.2), some(2, 0.1), [calculation] if rng.random() < 0.15 else None))
    return spark.createDataFrame(specs, S.SPEC)


def test_many_specs_over_odd_tables(spark):
    tables = made(spark)
    told = compare(spark, random_specs(spark, tables, 8, 400), tables)
    assert told["fine"] > 20, told


def test_many_rewrites_over_odd_tables(spark):
    tables = made(spark)
    parts = "CASE key WHEN 'sum' THEN array('q1', 'q2', 'q4') WHEN 'both' THEN array('north', 'south') END"
    tables = tables._replace(rows=tables.rows.selectExpr("*", f"{parts} AS parts"))
    won = compare_rewrites(spark, random_specs(spark, tables, 9, 300), tables)
    assert len(won) >= 9 and any(h and h.endswith("one unit") for h in won), won


def test_no_specs(spark):
    assert S.resolved(spark.createDataFrame([], S.SPEC), made(spark)).collect() == []


def column_to_run_down(p, table, periods):
    cols = [c for c in p.columns[table] if c["type"] in S.MEASURED]
    cols = [c for c in cols if c["period"] in periods] or cols
    measure = next((c["measure"] for c in cols if c["measure"]), None)
    cols = [c for c in cols if measure is None or c["measure"] == measure]
    return max(cols, key=lambda c: c["end"].toordinal() if c["end"] else 0)["key"] if cols else None


def forms(p, s):
    """(how, spec) of every form in turn."""
    none = {"highlight": [], "calculations": []}
    refs = [parts(r) for r in dict.fromkeys(s["series"] or [])]
    flipped = None
    if len(refs) > 1 and len({t for t, _ in refs}) == 1 and refs[0][0] in p.tables and all(any(r["key"] == k and r["type"] != "section" for r in p.rows[t]) for t, k in refs):
        t = refs[0][0]
        if column := column_to_run_down(p, t, s["periods"] or []):
            flipped = s | none | {"tables": [t], "series": [f"{t}:{column}"], "categories": list(dict.fromkeys(s["series"])), "periods": []}
    out = [("as given", s)]
    if flipped and s["kind"] in ("donut", "waterfall"):
        out.append(("transposed", flipped))
    base = flipped or s
    if s["kind"] == "waterfall" and base["tables"] and (t := base["tables"][0]) in p.tables:
        chosen = {parts(r)[1] for r in [*base["series"], *(base["categories"] or [])] if r.startswith(f"{t}:")}
        column = next((k for x, k in map(parts, base["series"]) if x == t and any(c["key"] == k and c["period"] for c in p.columns[t])), None) or column_to_run_down(p, t, base["periods"] or [])
        totals = [r for r in p.rows[t] if r["type"] == "total" and len(r["parts"] or []) > 1 and not r["period"]]
        for r in sorted(totals, key=lambda r: -len(chosen & {*r["parts"], r["key"]})) if column else []:
            out.append(("bridge", s | none | {"x": None, "tables": [t], "series": [f"{t}:{column}"], "categories": [f"{t}:{k}" for k in [*r["parts"], r["key"]]], "periods": []}))
    bare = s | none
    no_filters = bare | {"periods": [], "categories": []}
    out += [("plain", bare), ("no filters", no_filters)]
    if flipped and s["kind"] not in ("donut", "waterfall"):
        out.append(("transposed", flipped))
    kind = s["kind"]
    while kind := FALLBACK.get(kind):
        out += [("other kind", bare | {"kind": kind}), ("other kind, no filters", no_filters | {"kind": kind})] + ([("other kind, transposed", flipped | {"kind": kind})] if flipped else [])
    if len(s["series"] or []) > 1:
        out.append(("first series", bare | {"series": s["series"][:1]}))
    return out


def narrowed(p, s):
    t, key = parts(s["series"][0]) if len(s["series"] or []) == 1 else (None, None)
    if t not in p.tables or all(c["key"] != key for c in p.columns[t]):
        return None
    cells = [(r["key"], p.cells[t, r["key"], key]["unit"]) for r in p.rows[t] if r["type"] == "data" and p.cells.get((t, r["key"], key), {"value": None})["value"] is not None]
    units = Counter(u for _, u in cells)
    rows = [f"{t}:{k}" for k, u in cells if u == units.most_common(1)[0][0]]
    return s | {"categories": rows, "periods": []} if len(units) > 1 and len(rows) > 1 else None


def rewritten(p, s):
    for how, form in forms(p, s):
        got = p.resolve(form)
        if isinstance(got, tuple):
            return how, form["kind"], *got
        if any(x.startswith("mixed units") for x in got) and (less := narrowed(p, form)) and isinstance(got := p.resolve(less), tuple):
            return f"{how}, one unit", form["kind"], *got
    return None, None, None, None


def compare_rewrites(spark, asked, tables):
    p, won = Plain(*map(rows_of, tables)), Counter()
    got = {r.spec: r for r in R.first_valid(asked, tables).collect()}
    for s in rows_of(asked):
        r = got.pop(s["spec"])
        assert (r.how, r.kind, r.x, r.series and [tuple(x) for x in r.series]) == rewritten(p, s), s
        won[r.how] += 1
    assert not got
    return won


@pytest.mark.skipif(not Path(SF).exists(), reason="the tables aren't here")
def test_rewrites_over_the_printed_grids(spark):
    tables = Q.printed(spark, SF)
    won = compare_rewrites(spark, Q.asked(tables, Q.ASKED + Q.MENDED), tables)
    assert set(won) >= {None, "as given", "transposed", "bridge", "plain", "no filters", "other kind", "other kind, no filters", "other kind, transposed", "first series", "other kind, one unit"} - {"other kind, one unit"}, won


def test_one_document(spark):
    tables = made(spark)
    tables = tables._replace(tables=tables.tables.selectExpr("*", "CASE WHEN table IN ('A', 'B') THEN 'x' ELSE 'y' END AS document"))
    specs = [
        (1, "bar", ["A", "C"], None, ["C:sales", "A:debt"], [], ["A:debt", "C:north", "x"], ["C:north", "FY24"], [("growth", "A:debt", None, None, None), ("growth", "C:sales", None, None, None)]),
        (2, "bar", ["A", "B"], None, ["A:debt"], ["FY24"], [], [], []), (3, "bar", ["C", "A"], None, ["Z:x"], [], [], [], []), (4, "timeline", ["C", "A"], None, [], [], [], [], []), (5, "bar", ["Z"], None, ["Z:x"], [], [], [], []),
    ]
    got = {r.spec: r for r in R.one_document(spark.createDataFrame(specs, S.SPEC), tables).collect()}
    assert set(got) == {1, 2, 4, 5}
    assert (got[1].tables, got[1].series, got[1].categories, got[1].highlight, [c.series for c in got[1].calculations]) == (["C"], ["C:sales"], ["C:north", "x"], ["C:north", "FY24"], ["C:sales"])
    assert got[2].tables == ["A", "B"] and got[4].tables == ["C"] and got[5].tables == ["Z"]
