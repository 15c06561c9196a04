import time

from pyspark.sql import Row
from pyspark.sql import functions as F

from seqcomplexity.llm import chat, urlfilter


def lists(spark, rows):
    return spark.createDataFrame(rows, "key string, action string, effective_at long")


def test_intervals(spark):
    rows = [("a.com", "block", 10), ("a.com", "remove", 20), ("a.com", "allow", 20), ("a.com", "block", 30), ("b.com", "remove", 5), (None, "block", 1), ("c.com", "odd", 1), ("c.com", "block", None)]
    got = {tuple(r) for r in urlfilter.validity_intervals(lists(spark, rows)).collect()}
    assert got == {("a.com", "block", 10, 20), ("a.com", "allow", 20, 30), ("a.com", "block", 30, None)}


def test_captures_against_plain_evaluation(spark):
    entries = [("example.com", "block", 100), ("sub.example.com", "allow", 150), ("sub.example.com", "remove", 250), ("sub.example.com/a", "block", 120), ("sub.example.com/a/b", "allow", 200), ("com", "block", 900), ("x", "block", 0)]
    urls = ["http://sub.example.com/a/b?q#f", "https://SUB.example.com:8080/a", "http://user@sub.example.com./", "http://example.com", "http://other.org/a", "no url", "", None, "http://xexample.com/"]
    captures = [(i * 100 + t // 50, u, t) for i, u in enumerate(urls) for t in range(50, 1000, 50)] + [(5000, urls[0], None), (None, urls[0], 300), (7, urls[0], 300), (7, urls[0], 300)]
    df = spark.createDataFrame([Row(page_id=p, url=u, fetched_at=t, key="clash", host=1) for p, u, t in captures], "page_id long, url string, fetched_at long, key string, host int")

    def plain(url, at):
        host, steps = "", []
        if url and "://" in url:
            rest = url.split("://", 1)[1].split("#")[0].split("?")[0]
            host, _, path = rest.partition("/")
            host = host.rsplit("@", 1)[-1].split(":")[0].lower().rstrip(".")
            steps = [s for s in path.split("/") if s]
        labels = host.split(".") if host else []
        keys = [".".join(labels[i:]) for i in range(len(labels))] + [host + "/" + "/".join(steps[:i + 1]) for i in range(len(steps) if host else 0)]
        best = None
        for key in keys:
            dated = [(t, a) for k, a, t in entries if k == key and at is not None and t <= at]
            if dated and (action := max(dated)[1]) != "remove":
                best = max(best or ("/" in key, len(key), key, action), ("/" in key, len(key), key, action))
        return host, bool(best) and best[3] == "block", best and best[2]

    got = urlfilter.filter_captures(df, lists(spark, entries)).collect()
    key = lambda x: tuple((v is None, str(v)) for v in x)
    assert sorted(((r.page_id, r.fetched_at, r.host, r.blocked, r.matched_key) for r in got), key=key) == sorted(((p, t, *plain(u, t)) for p, u, t in captures), key=key)
    assert urlfilter.filter_captures(df.limit(0), lists(spark, entries)).count() == 0
    assert not any(r.blocked for r in urlfilter.filter_captures(df, lists(spark, [])).collect())


def test_long_urls(spark):
    """Twice the segments take about twice the time: only prefixes as deep as the list's keys are tried."""
    entries = lists(spark, [("a.com/x/x", "block", 5), ("com", "allow", 1)])
    took = []
    for n in (100_000, 200_000):
        df = spark.createDataFrame([(1, "http://a.com/" + "x/" * n, 10), (2, "http://" + "l." * n + "com/", 10)], "page_id long, url string, fetched_at long")
        urlfilter.filter_captures(df, entries).collect()
        begin = time.perf_counter()
        rows = {r.page_id: (r.blocked, r.matched_key) for r in urlfilter.filter_captures(df, entries).collect()}
        took.append(time.perf_counter() - begin)
        assert rows == {1: (True, "a.com/x/x"), 2: (False, "com")}
    assert took[1] < 2.5 * took[0] + 1


def test_dominating_conversation(spark):
    """A conversation with nearly all turns, of many participants: every view is whole and offsets add up."""
    rows = [(1, i, f"p{i % 30}", "x" * (i % 5)) for i in range(1500)] + [(2, 0, "user", "hi")]
    out = chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    views = {(r.conv_id, r.perspective): r for r in out.groupBy("conv_id", "perspective").agg(F.count("*").alias("n"), F.sum(F.length("segment")).alias("size"), F.max("segment_end").alias("end"), F.max("position").alias("last"), F.count("mask_start").alias("spoken")).collect()}
    assert len(views) == 31 and all((v.n, v.size, v.last, v.spoken) == (1500, v.end, 1499, 50) for k, v in views.items() if k[0] == 1)


def render(rows, me):
    out, spans = "", []
    for turn, role, text in rows:
        head = {"system": "system", me: "assistant"}.get(role, f"user name={role}")
        start = len(out) + len(f"<|im_start|>{head}\n")
        out += f"<|im_start|>{head}\n{text}<|im_end|>\n"
        spans.append((start, len(out) - 1) if role == me else (None, None))
    return out, spans


def test_rotation(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(chat, "CHUNK_TURNS", 3)
    talks = {1: [(0, "system", "be kind"), *[(i, ["ann", "bob", "eve"][i * 7 % 3], f"é turn {i}" * (i % 4)) for i in range(1, 20)]], 2: [(0, "user", None), (1, None, "who"), (1, " ", "who"), (1, "user", "who"), (None, "user", "first")], 3: [(0, "system", "alone")], None: [(0, "user", "lost")]}
    rows = [Row(conv_id=c, turn=t, role=r, text=x, name="clash", chunk="c") for c, talk in talks.items() for t, r, x in talk]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, name string, chunk string")
    got = {}
    for r in chat.rotate_perspectives(df).collect():
        got.setdefault((r.conv_id, r.perspective), []).append(r)
    expected = set()
    for c, talk in talks.items():
        clean = [(t, (r or "").strip() or "unknown", x or "") for t, r, x in talk]
        clean.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
        for me in {r for _, r, _ in clean} - {"system"}:
            expected.add((c, me))
            own = sorted(got[c, me], key=lambda r: r.position)
            text, spans = render(clean, me)
            assert "".join(r.segment for r in own) == text and [r.position for r in own] == list(range(len(clean)))
            assert [(r.mask_start, r.mask_end) for r in own] == [(a, b and b) for a, b in spans]
            assert all(text[r.segment_start:r.segment_end] == r.segment for r in own)
            assert all(text[r.mask_start:r.mask_end] == x + "<|im_end|>" for r, (_, role, x) in zip(own, clean) if role == me)
    assert set(got) == expected
    assert chat.rotate_perspectives(df.limit(0)).count() == 0
