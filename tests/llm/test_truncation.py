from arcweave.llm import truncation as T

ENDS = ["the old house burns down.", "nobody comes back home.", "the river remembers everything!", "a secret is kept here?"]


def corpus():
    """Whole values of a small grammar, from three sources."""
    rows, k = [], 0
    for i in range(400):
        s = " ".join([f"Once number {i % 17} waits, and {ENDS[i % 4]}", f"Later in the year {ENDS[(i // 4) % 4]}"][: 1 + i % 2])
        tag = ENDS[i % 4][:-1] if i // 4 % 2 else ENDS[i % 4]
        rows.append((k, ["feed", "press", None][i % 3], s, tag))
        k += 1
    return rows


def cut(spark, rows):
    df = spark.createDataFrame(rows, "id long, source string, summary string, tagline string")
    return sorted({(r.id, r.field_name) for r in T.truncated(df).collect()})


def test_kinds_of_endings(spark):
    rows = corpus()
    bad = [
        (1000, "feed", "Once number 4 waits, and the old hou", "nobody comes ba"),
        (1001, "feed", "Once number 4 waits,", "the river remembers"),
        (1002, "press", "Once number 4 waits, and the ol...", "the old house bur…"),
        (1003, None, "Once number 4 waits, and a secret is kept here", "x"),  # a summary may not lack its mark
        (1004, "press", "Once number 4 waits (in the", None),
        (1005, "press", "Once number 4 waits �", ""),
    ]
    good = [
        (2000, "feed", "Once number 4 waits, and nobody comes back home.” ", "nobody comes back home"),
        (2001, "feed", "Later in the year the old house burns down. (52 min)", "the river remembers everything…"),
        (2002, "press", "Later in the year a secret is kept here… [restored]", "a secret is kept here"),
        (2003, None, "Later in the year nobody comes back home! ★★★", "  "),
        (2004, None, None, None),
        (None, "feed", "", "the old house burns down"),
    ]
    want = sorted([(i, f) for i in (1000, 1001, 1002) for f in ("summary", "tagline")] + [(1003, "summary"), (1003, "tagline"), (1004, "summary"), (1005, "summary")])
    assert cut(spark, rows + bad + good + [bad[0]]) == want


def test_a_feed_that_marks_its_cuts(spark):
    """At the limit of a source that cuts and marks, a marked value is cut
    even if it happens to stop at a known ending."""
    rows, limit = corpus(), 60
    for i in range(40):
        text = f"Number {i:02d} of a long tale that goes on and on and on and {ENDS[i % 4]}"
        rows.append((3000 + i, "cutter", text[: limit - 3] + "...", None))
    whole = "Later it so happens on a quiet day that nobody comes back home..."
    rows.append((3999, "cutter", whole[len(whole) - limit :].capitalize(), None))
    assert [i for i, _ in cut(spark, rows)] == [*range(3000, 3040), 3999]


def test_shares_and_empty(spark):
    df = spark.createDataFrame(corpus() + [(1000, "feed", "Once number 4 waits, and the old hou", None)] * 2, "id long, source string, summary string, tagline string")
    got = {r.source: (r.n_values, r.n_cut) for r in T.share_by_source(df).collect()}
    assert got["feed"][1] == 1 and got["press"][1] == 0 and None in got
    assert T.truncated(df.filter("false")).count() == 0


def by(spark, rows):
    df = spark.createDataFrame(rows, "id long, source string, summary string, tagline string")
    return {(r.id, r.field_name): r.by for r in T.judge(df, "id", ["summary", "tagline"], "source").collect()}


def test_spikes_flag_and_endings_do_the_rest(spark):
    """At a feed's limit the spike flags; elsewhere the ending decides."""
    rows, limit = corpus(), 57
    for i in range(40):
        text = f"Number {i:02d} of a tale that goes on and {['on', 'up', 'out'][i % 3]} and on and then {ENDS[i % 4]}"
        rows.append((3000 + i, "limited", text[:limit], None))
    rows.append((3900, "limited", "Once number 4 waits, and the old hou", None))
    rows.append((3901, "limited", ("Once number 4 waits, and nobody comes back home." + " " * 20)[:limit], None))  # whole at the limit
    got = by(spark, rows)
    assert all(got[3000 + i, "summary"] == "spike" for i in range(40))
    assert got[3900, "summary"] == "ending" and got[3901, "summary"] is None


def test_known_endings_that_pile_up(spark):
    """Unmarked values at a known ending are whole unless they pile up at a
    limit where values of that length with a mark don't."""
    rows = [(k, "feed", None, ENDS[k % 4][: -1 if k // 4 % 2 else None]) for k in range(400)]
    rows += [(1000 + k, "feed", None, f"It was a long year {k:02d} and nobody comes back home") for k in range(30)]
    rows += [(2000 + k, "feed", None, f"It was a long year {k:02d} and nobody ever comes back home"[:48]) for k in range(5)]
    got = by(spark, rows)
    assert all(got[k, "tagline"] is None for k in range(400))
    assert all(got[1000 + k, "tagline"] == "spike" for k in range(30))


def test_a_natural_ellipsis_at_a_limit(spark):
    """A feed that marks its cuts with dots doesn't make an ellipsis a cut."""
    rows, limit = corpus(), 60
    for i in range(40):
        text = f"Number {i:02d} of a long tale that goes on and on and on and {ENDS[i % 4]}"
        rows.append((3000 + i, "cutter", text[: limit - 3] + "...", None))
    whole = "Later it so happens on a very quiet day nobody comes back home…"
    rows.append((3999, "cutter", whole[len(whole) - limit + 2 :].capitalize(), None))
    got = by(spark, rows)
    assert got[3000, "summary"] == "spike" and got[3999, "summary"] is None
