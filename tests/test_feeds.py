"""p2, p3 and p5: edge cases against brute force."""

import datetime as dt
import random

from arcweave.operators import badrows, heavykeys, orphans


def t(h):
    return None if h is None else dt.datetime(2025, 1, 1) + dt.timedelta(hours=h)


def test_orphans_against_brute_force(spark):
    rng = random.Random(4)
    lives = [(k, t(a), t(b)) for k in range(12) for a, b in [(rng.randint(0, 20), rng.choice([None, rng.randint(0, 60)]))] * rng.randint(1, 2)]
    lives += [(3, t(70), None), (None, t(0), None), (20, None, None), (21, t(5), t(5)), (22, t(9), t(2))]
    refs = [(i, rng.choice(["A", "B", None]), rng.choice([None, 7, *range(24)]), t(rng.choice([None, rng.randint(0, 90)]))) for i in range(500)]
    refs += [(1000 + i, "A", 7, t(i % 90)) for i in range(400)] + [refs[0]]
    r = spark.createDataFrame(refs, "line_no long, kind string, key long, at timestamp_ntz")
    v = spark.createDataFrame(lives, "id long, loaded_at timestamp_ntz, dropped_at timestamp_ntz")
    want = sorted(i for i, kind, k, at in refs if k is not None and not (kind == "A" and at is not None and any(x == k and a is not None and a <= at and (b is None or b > at) for x, a, b in lives)))
    for share in (0.01, 0.9):
        got = orphans.orphans(r, orphans.existence_deltas(v, "A"), hot_share=share)
        assert sorted(x.line_no for x in got.collect()) == want
    report = orphans.orphan_report(orphans.orphans(r, orphans.existence_deltas(v, "A"))).collect()
    assert sum(x.n_refs for x in report) == len(want)
    assert orphans.orphans(r.filter("false"), orphans.existence_deltas(v, "A")).count() == 0
    assert orphans.orphans(r, orphans.existence_deltas(v.filter("false"), "A")).count() == sum(k is not None for _, _, k, _ in refs)


def test_ledger_with_late_changes(spark):
    led = orphans.empty_ledger(spark)
    change = lambda rows: spark.createDataFrame(rows, "kind string, key long, d_refs long, d_existing long")
    led = orphans.apply_changes(led, change([("A", 1, 1, 0), ("A", 2, 2, 1), ("A", None, 1, 0)]))
    assert {(r.key, r.refs) for r in orphans.current_orphans(led).collect()} == {(1, 1)}
    led = orphans.apply_changes(led, change([("A", 1, 0, 1), ("A", 2, 0, -1), ("A", 2, -1, 0)]))
    assert {(r.key, r.refs) for r in orphans.current_orphans(led).collect()} == {(2, 1)}
    led = orphans.apply_changes(led, change([("A", 2, -1, 0), ("A", 1, -1, -1)]))
    assert led.count() == 0


def test_heavy_keys(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 1, -5, None, 2**60, *range(50)]), rng.choice([None, 1, 2]), rng.choice([None, 0.5, -2.0, 3.25]), "x") for _ in range(3000)]
    df = spark.createDataFrame(rows, "a long, e int, amount double, total string").repartition(6)
    per = heavykeys.aggregate_by_key(df, ["a", "e"], "amount", slices=3, fan_in=2)
    got = {(r.key_field, r.key_value): (r.n_rows, r.n_values, r.total) for r in per.collect()}
    want = {}
    for a, e, x, _ in rows:
        for f, k in (("a", a), ("e", e)):
            n, m, s = want.get((f, k), (0, 0, None))
            want[f, k] = (n + 1, m + (x is not None), s if x is None else (s or 0.0) + x)
    assert got == want
    heavy = {(r.key_field, r.key_value) for r in heavykeys.heavy_keys(per, {"a": 0.05, "e": 0.3}).collect()}
    assert heavy == {(f, k) for (f, k), v in want.items() if k is not None and v[0] >= (0.05 if f == "a" else 0.3) * 3000}
    assert heavykeys.aggregate_by_key(df.filter("false"), ["a"], "amount").count() == 0


def parse(raw):
    """A plain reading of the row format."""
    if raw is None:
        return "column_count", None
    fields, i = [], 0
    while True:
        if raw[i : i + 1] == '"':
            j, text = i + 1, ""
            while True:
                k = raw.find('"', j)
                if k < 0:
                    return "quoting", None
                text += raw[j:k]
                if raw[k + 1 : k + 2] == '"':
                    text += '"'
                    j = k + 2
                    continue
                break
            i = k + 1
            if raw[i : i + 1] not in ("", ","):
                return "quoting", None
            fields.append(text)
        else:
            k = raw.find(",", i)
            k = len(raw) if k < 0 else k
            if '"' in raw[i:k]:
                return "quoting", None
            fields.append(raw[i:k])
            i = k
        if i >= len(raw):
            break
        i += 1
    if len(fields) != 7:
        return "column_count", None
    ok = fields[0].isdigit() and fields[0].isascii() and len(fields[0]) <= 18 and (fields[1] in ("", r"\N") or fields[1].isdigit() and fields[1].isascii() and len(fields[1]) <= 4)
    ok = ok and not any(c in "�\x7f" or (ord(c) < 32 and c not in "\t\n") for f in fields[2:] for c in f)
    return (None, fields) if ok else ("invalid_value", None)


def test_bad_rows_against_plain_reading(spark):
    rng = random.Random(9)
    raws = [None, "", ",,,,,,", '1,2,"a","b,""c""\n",,x,y', '1,2,a,b,c,d,e\n', '1,\\N,a,b,c,d,"e"', '12345678901234567890,1,a,b,c,d,e', '1,2,"' + "x,\n" * 20000 + '",b,c,d,e', "1,2," + '""' * 9000 + ",b,c,d,e", '1,2,a,b\r,c,d,e', '1,2,a\tb,b\n,c,d,"\x7f"', "١,2,a,b,c,d,e"]
    raws += ["".join(rng.choice(['"', '""', ",", ",", "1", "a", " ", "\n", "\\N"]) for _ in range(rng.randint(0, 24))) for _ in range(1500)]
    raws += ["1,2," + ",".join(rng.choice(["a", '"b"', '"c,""d"', "", '"e', 'f"', '"g"h', "�"]) for _ in range(5)) for _ in range(500)]
    df = spark.createDataFrame([(i, r, "q", "z") for i, r in enumerate(raws)], "line_no long, raw string, errors string, title string")
    checked = badrows.check_rows(df, "raw", badrows.MOVIE_COLUMNS)
    bad = {r.line_no: r.reason for r in badrows.rejected(checked).collect()}
    good = {r.line_no: r for r in badrows.valid(checked, badrows.MOVIE_COLUMNS).collect()}
    assert len(bad) + len(good) == len(raws)
    for i, raw in enumerate(raws):
        reason, fields = parse(raw)
        assert bad.get(i) == reason, (i, raw[:60] if raw else raw)
        if fields:
            r = good[i]
            assert (r.id, r.tagline, r.rated, r.in_title) == (int(fields[0]), fields[3], fields[6], "z")
            assert r.duration == (None if fields[1] in ("", r"\N") else int(fields[1]))


def test_cast_rules_name_the_columns(spark):
    """A text that its type doesn't take is an error even without a pattern."""
    from arcweave.operators import badrows as B

    cols = [B.TextColumn("a", "int", nulls=("",)), B.TextColumn("b", "date"), B.TextColumn("c", "string", forbid="x")]
    df = spark.createDataFrame([(1, "1,2020-01-01,k"), (2, "99999999999,2020-13-01,x"), (3, ",2020-01-01,x"), (4, "1,2,3,4"), (5, '"a')], "n long, raw string")
    checked = B.check_rows(df, "raw", cols)
    assert {r.n: r.errors for r in checked.collect()} == {1: [], 2: ["invalid_value:a", "invalid_value:b", "invalid_value:c"], 3: ["invalid_value:c"], 4: ["column_count"], 5: ["quoting"]}
    assert {r.n: r.reason for r in B.rejected(checked).collect()} == {2: "invalid_value", 3: "invalid_value", 4: "column_count", 5: "quoting"}
    assert B.valid(checked, cols).filter("a is null or b is null").count() == 0
