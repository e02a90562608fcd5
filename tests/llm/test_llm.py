"""Each operator against a brute-force version or an exact property, and on rows that are odd: null, empty, very long, tied,
repeated, with columns of clashing names; and on empty tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import dartminhash, hilbert, langid, mincut, mixing, packing, pii, quality, rollup, winnow
from strandlake.llm.tokens import Encoder

CLASH = "row bigint, rank int, length int, comp string, band int, piece string, place int, bucket int, curve int, part int, slot int"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASH}"
PROSE = [" ".join(np.random.default_rng(i).choice(["the", "of", "and", "harbour", "winter", "seven", "rivers", "carry", "stone", "light"], 60)) + "." for i in range(12)]
TEXTS = [None, "", "  \n ", "one", PROSE[0], PROSE[0], PROSE[1], PROSE[1] + " and more", "word " * 30000, "漢字テスト" * 50, "1234 5678", "!!! ???", "\U0001f600 é ﬁ İ Σας", *PROSE[2:]]


def frame(spark, texts=TEXTS, empty=False):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t or ""), *[0, 1, 2, "c", 3, "p", 4, 5, 6, 7, 8]) for i, t in enumerate(texts)]
    rows += [rows[4], (None, PROSE[0], None, None, None, *[None] * 11)]
    return spark.createDataFrame([] if empty else rows, SCHEMA)


# 1 main text -----------------------------------------------------------------------------------------------------------


def test_main_text():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><header class='site'>Site name</header><nav><ul><li><a href='/'>Home</a></li></ul></nav>"
        "<div class='cookie-notice'>We use cookies to improve this site for all of you.</div><div class='main-wrapper sidebar-left'><article><h1>Title &amp; more</h1><p>First  <b>bold</b><br>line &quot;x&quot; goes on for a while here.</p>"
        "<div class='ad'>Buy now, buy cheap.</div><form><label>Mail</label><button>Send</button></form><table><tr><td>a</td><td>b</td></tr></table><p>Short.</p>"
        "<section id='comments'><p>I do not agree with this at all, my friend.</p></section></article><aside>Related things</aside></div><footer>&copy; someone</footer></body></html>"
    )
    assert mincut.main_text(page) == 'Title & more First bold line "x" goes on for a while here. a b Short.'
    assert mincut.main_text(None) == mincut.main_text("") == mincut.main_text("<p") == mincut.main_text("<div></div>") == ""
    long = "This is a plain page without any article element, but with long prose in it. " * 4
    assert mincut.main_text(f"<body><div class='menu'><a href=x>a</a> <a href=y>b</a></div><p>{long}</p></body>") == long.strip()
    assert len(mincut.main_text("<article>" + "<p>Some words here.</p>" * 3000)) == 3000 * 17 - 1


PRIOR = np.array(list(mincut.PRIOR.values()))


def test_cut_overrules_the_score_both_ways():
    page = "".join(f"<p>This is sentence number {i} of the page, and it has a plain ending.</p><p>ab</p>" for i in range(50))
    menu = "<ul><li><a href=1>Home</a></li><li><a href=2>About us</a></li><li>News of the day.</li><li><a href=3>Contact</a></li><li><a href=4>Jobs</a></li></ul>"
    advert = "<article><p>One line of the story that is told.</p></article><div class=ad><p>Buy our wonderful things now, they are cheaper than ever, and you will like them.</p></div>"
    for text, overruled, want in ((page, "ab", True), (menu, "News of the day.", False), (advert, "Buy our wonderful things now, they are cheaper than ever, and you will like them.", False)):
        found = mincut.blocks(text)
        scores, joined = mincut.graph(found, PRIOR)
        side = mincut.cut(scores, joined)
        at = [i for i, b in enumerate(found) if b.text == overruled]
        assert at and all((scores[i] > 0) != want and side[i] == want for i in at[: len(at) - (overruled == "ab")])


def test_nothing_is_lost_beside_an_article_or_after_unclosed_elements():
    page = "".join(f"<p>This is sentence number {i} of a long page, and it has its plain ending here.</p><p>ab</p>" for i in range(2000))
    whole = mincut.main_text(page)
    assert whole.count("sentence number") == 2000 and whole.count(" ab") >= 1999
    assert mincut.main_text("<article><p>One sentence only, in the article.</p></article>" + page).count("sentence number") == 2000
    assert mincut.main_text("<p>a video <video src=x> and then the rest of it.</p><p>More text follows here.</p>") == "a video and then the rest of it. More text follows here."
    assert mincut.main_text('<article><p>Lead one two three.</p><div class="alert-story comment-on-policy"><p>What the policy says on comments.</p></div></article>').endswith("on comments.")
    assert mincut.main_text("<article><p>Kept as it is.</p><script>var x = 1;</article>") == "Kept as it is."


def test_long_pages_take_linear_time():
    import time

    line = "This is a full sentence of about seventy-six characters with some more words. "
    mixed = "".join(f"<p>{line * 2 if i % 2 else 'x y'}</p><div><a href=x>link {i}</a></div>" for i in range(3500))
    for page in (mixed, "<div>" * 4000 + line + "</div>" * 4000 + "<p>more</p>", "<div><p>a b c</p>" * 4000, "<video>text " * 20000):
        start = time.process_time()
        mincut.main_text(page)
        assert time.process_time() - start < 2


def test_weights_are_learned_from_marked_pages(spark):
    rows = [(2**60 + i, f"<nav><a href=x>Go {i}</a></nav><article><p>{'This is the text of it, which goes on. ' * 4}</p></article><div class=ad>Buy</div>") for i in range(40)]
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (7, None)], "page_id bigint, html string")
    w = mincut.fit(df)
    assert w.shape == PRIOR.shape and np.abs(w - PRIOR).max() > 0.05 and np.allclose(w, mincut.fit(df.repartition(3)))
    assert (mincut.fit(df.where("page_id < 0")) == PRIOR).all() and (mincut.learn([]) == PRIOR).all()


def test_minimum_cut_against_enumeration():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(1, 8))
        s = rng.normal(0, 2, n).round(3).tolist()
        e = [(i, j, int(rng.integers(0, 2500))) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda side: sum(int(1000 * abs(x)) for x, k in zip(s, side) if (x > 0) != k) + sum(c for a, b, c in e if side[a] != side[b])  # noqa: E731, B023
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(2**n))
        assert cost(mincut.cut(s, e)) <= best + n + 1  # capacities are whole numbers


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "<article><p>Hi there.</p></article>", None), (2, None, "<article><p>Hi there.</p></article>", None)], "page_id bigint, url string, html string, text string")
    out = {(r["page_id"], r["text"], r["n_chars"]) for r in mincut.extract(df).collect()}
    assert out == {(1, "", 0), (2, "Hi there.", 9)}
    assert mincut.extract(df.where("page_id > 9")).count() == 0


# 2 token rollup --------------------------------------------------------------------------------------------------------


def test_rollup_is_idempotent_and_compacts(spark, tmp_path):
    r = rollup.TokenRollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    df = spark.createDataFrame([("a", "en", "v1", 5, 7), ("a", "en", "v1", 3, None), (None, None, "v1", None, 1), ("b", "de", "v1", 4, 4)], "source string, lang string, tokenizer string, tokens bigint, new_tokens bigint")
    assert r.commit("one", rollup.inserted(df)) and not r.commit("one", rollup.inserted(df))
    assert r.commit("two", rollup.revised(df)) and r.commit("three", rollup.deleted(df.where("source = 'b'")))
    want = {("a", "en", "v1", 2, 7), (None, None, "v1", 1, 1)}
    assert {tuple(x) for x in r.totals().collect()} == want
    r.compact()
    assert {tuple(x) for x in r.totals().collect()} == want and r.committed() == {"one", "two", "three"} and not r.commit("two", rollup.inserted(df))
    with pytest.raises(ValueError):
        r.commit("../x", rollup.inserted(df))


def test_rollup_compacts_many_long_ids_and_survives_interruption(spark, tmp_path):
    r = rollup.TokenRollup(spark, str(tmp_path / "r"))
    df = spark.createDataFrame([("a", "en", "v1", 5)], "source string, lang string, tokenizer string, tokens bigint")
    ids = [f"batch-of-a-rather-long-name-{i:05d}" for i in range(12)]
    assert all(r.commit(i, rollup.inserted(df)) for i in ids)
    before = {f.name: f.read_bytes() for f in (tmp_path / "r").iterdir() if f.name.startswith("batch=")}
    r.compact()
    assert len([f for f in (tmp_path / "r").iterdir() if f.name.startswith("batch=")]) == 1 and r.committed() == set(ids)
    assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "v1", 12, 60)]
    (tmp_path / "r" / f"batch={ids[3]}").write_bytes(before[f"batch={ids[3]}"])  # as a compaction would leave it that ends too early
    assert r.totals().first()["tokens"] == 60 and not r.commit(ids[3], rollup.inserted(df))
    assert not r._put(df.withColumn("docs", F.lit(1)), f"batch={ids[3]}", [ids[3]])  # a second writer that has not seen the first
    assert r.commit("empty", rollup.inserted(df.where("false"))) and r.totals().first()["tokens"] == 60


def test_rollup_query_against_recount(spark):
    import pandas as pd

    docs, labels = (pd.read_parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    toxic, e = set(labels[labels.toxic == 1].doc_id), Encoder(packing.vocabulary())
    want = collections.defaultdict(lambda: [0, 0])
    for r in docs.itertuples():
        text = re.sub(r"\n[^\n]*\blicen[cs]e[^\n]*", "", r.text or "", flags=re.I)
        if r.doc_id not in toxic:
            for kind, n in (("words-1", len(re.findall(r"[^ \t\n\r\f\x0b]+", text))), ("word_bpe_49k-1", len(e.tokenizer.encode(text, add_special_tokens=False).ids))):
                key = (r.source if isinstance(r.source, str) else None, r.lang if isinstance(r.lang, str) else None, kind)
                want[key][0] += 1
                want[key][1] += n
    got = {(r["source"], r["lang"], r["tokenizer"]): [r["docs"], r["tokens"]] for r in rollup.op2_token_rollup(spark, "/root/testdata/sf0.001").collect()}
    assert got == dict(want)


def test_counts_of_odd_rows(spark):
    df = frame(spark).withColumn("tokens", F.lit("x"))
    got = rollup.count_tokens(df, {"text": "tokens"}, packing.vocabulary())
    assert got.columns == [c for c in df.columns if c not in ("text", "tokens")] + ["tokens"]
    rows = got.collect()
    by, e = {r["doc_id"]: r["tokens"] for r in rows}, Encoder(packing.vocabulary())
    assert len(rows) == len(TEXTS) + 2 and all(by[i] == (None if t is None else len(e.tokenizer.encode(t, add_special_tokens=False).ids)) for i, t in enumerate(TEXTS))
    assert rollup.count_tokens(frame(spark, empty=True), {"text": "tokens"}, packing.vocabulary()).count() == 0


# 3 quality -------------------------------------------------------------------------------------------------------------


def test_quality_learns_and_scores_all(spark):
    rng = np.random.default_rng(0)
    good = [" ".join(rng.choice("the of and harbour winter seven rivers carry stone light".split(), 80)) + "." for _ in range(120)]
    bad = [" ".join(f"{w}***" for w in rng.choice("harbour winter seven".split(), 80)) for _ in range(120)]
    m = quality.train(good[:100] + bad[:100], [1] * 100 + [0] * 100)
    s = m.score(good[100:] + bad[100:])
    assert (s[:20] > 0.7).all() and (s[20:] < 0.3).all()
    out = quality.score(frame(spark).withColumn("quality_score", F.lit("x")), m).collect()
    assert len(out) == len(TEXTS) + 2 and all(0 <= r["quality_score"] <= 1 for r in out)
    assert quality.score(frame(spark, empty=True), m).count() == 0 and (quality.train([], []).score([None, "a"]) == 0.5).all()
    assert quality.Model(m.w).score(["word " * 300000])[0] == pytest.approx(m.score(["word " * 300000])[0])


def test_quality_gradient_against_differences():
    rng = np.random.default_rng(5)
    bags = [(rng.normal(size=(int(rng.integers(1, 5)), quality.FEATURES)), int(rng.integers(0, 2))) for _ in range(6)]
    shapes = {"V": (quality.FEATURES, quality.HIDDEN), "v": (quality.HIDDEN,), "T": (quality.HIDDEN, quality.GATE), "S": (quality.HIDDEN, quality.GATE), "a": (quality.GATE,), "c": (quality.HIDDEN,), "b": (1,)}
    w = {k: rng.normal(0, 0.3, s) for k, s in shapes.items()} | {"mean": np.zeros(quality.FEATURES), "dev": np.ones(quality.FEATURES)}
    _, grad = quality.gradient(w, bags)
    for k, shape in shapes.items():
        for _ in range(4):
            at, step = tuple(int(rng.integers(0, n)) for n in shape), 1e-5
            up, down = ({**w, k: w[k].copy()} for _ in range(2))
            up[k][at] += step
            down[k][at] -= step
            assert grad[k][at] == pytest.approx((quality.gradient(up, bags)[0] - quality.gradient(down, bags)[0]) / (2 * step), rel=1e-3, abs=1e-7)


def test_quality_score_against_plain_attention():
    rng = np.random.default_rng(1)
    text = " ".join("".join(rng.choice(list("abcdeXY!|*0. "), 9)) for _ in range(400))
    m = quality.train([text, "plain words of a kind " * 30] * 8, [0, 1] * 8, epochs=2)
    x, w = quality.passages([text])[0], m.w
    top = bottom = 0.0
    for row in x:
        h = np.tanh(((row - w["mean"]) / w["dev"]) @ w["V"] + w["v"])
        a = math.exp(5 * math.tanh((np.tanh(h @ w["T"]) / (1 + np.exp(-(h @ w["S"])))) @ w["a"]))
        top, bottom = top + a * h, bottom + a
    assert m.score([text])[0] == pytest.approx(1 / (1 + math.exp(-(top / bottom @ w["c"] + w["b"][0]))))
    words = [w for i in range(0, len(text.split()), quality.WORDS) for w in [text.split()[i : i + quality.WORDS]]]
    assert len(x) == len(words) and x[:, 0] == pytest.approx([sum(map(len, p)) / 10 / len(p) for p in words], abs=1e-5)


def test_quality_query_on_held_out_rows(spark):
    import pandas as pd

    rows = quality.op3_quality(spark, "/root/testdata/sf0.01").toPandas()
    docs, labels = (pd.read_parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    assert sorted(rows.doc_id) == sorted(docs.doc_id) and rows.score.between(0, 1).all() and ((rows.score >= 0.3) == (rows.predicted == 1)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(rows.doc_id, rows.held_out, strict=True))
    both = rows[rows.held_out].merge(labels, on="doc_id")
    assert len(both) > 20 and (both.predicted == both.quality).mean() > 0.9


# 4 near duplicates -----------------------------------------------------------------------------------------------------


def cells(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    n = collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else {}
    return {(s, k) for s, c in n.items() for k in range(c)}


def brute_classes(texts):
    sets, parent = [cells(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    out = collections.defaultdict(set)
    for i in range(len(texts)):
        out[root(i)].add(i)
    return {frozenset(c) for c in out.values()}


def varied(n=160, seed=4):
    """Copies of one text with edits of all sizes, so that links form chains and rings."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(200)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(int(rng.integers(0, 12))):
            w[int(rng.integers(0, 200))] = f"x{rng.integers(0, 10**6)}"
        out.append(" ".join(w))
    return out + [" ".join(f"y{rng.integers(0, 10**6)}" for _ in range(50)) for _ in range(40)]


def classes(df):
    out = collections.defaultdict(set)
    for r in df.collect():
        out[r["class_id"]].add(r["doc_id"])
    return out


def test_near_duplicates_against_brute_force(spark):
    texts = varied()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = classes(dartminhash.near_duplicates(df))
    assert {frozenset(c) for c in got.values()} == brute_classes(texts)
    assert all(k == min(c) for k, c in got.items())


def test_near_duplicates_odd_rows(spark):
    df = frame(spark)
    out = dartminhash.near_duplicates(df).collect()
    by = {r["doc_id"]: r["class_id"] for r in out if r["doc_id"] is not None}
    assert len(out) == len(TEXTS) + 2 and by[0] == by[1] == by[2] == 0 and by[5] == by[4] == 4 and by[7] == by[6] == 6
    assert sum(r["keep"] for r in out) == len({r["class_id"] for r in out})
    kept = dartminhash.deduplicate(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} >= {0, 3, 4, 6} and kept.where("doc_id = 4").count() == 1
    assert dartminhash.near_duplicates(frame(spark, empty=True)).count() == 0


def test_deduplicate_tells_rows_of_one_key_apart(spark):
    rows = [(1, PROSE[0]), (2, PROSE[0]), (2, PROSE[1] + " long"), (2, PROSE[2]), (None, PROSE[3]), (None, PROSE[3]), (None, PROSE[0]), (None, PROSE[4]), (5, None), (5, "")]
    kept = dartminhash.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted([(1, PROSE[0]), (2, PROSE[1] + " long"), (2, PROSE[2]), (0, PROSE[3]), (0, PROSE[4]), (5, "")])


def test_dart_signatures_estimate_likeness():
    from strandlake.llm.shingles import cell_array, cells_of, shingles

    rng = np.random.default_rng(6)
    a = " ".join(f"w{i}" for i in range(400))
    for b in (" ".join(f"w{i}" for i in range(100, 500)), a + " " + "again and " * 150, "again and " * 300 + " ".join(f"w{i}" for i in range(300)), " ".join(rng.choice(["x", "y"], 400))):
        gram, count, of, _ = shingles([a, b, "again and " * 200 + a])
        s = dartminhash.signatures(gram, count, of, 3, 2000)
        for i, j, y in ((0, 1, b), (2, 1, b)):
            x, y = cells((a, b, "again and " * 200 + a)[i]), cells(y)
            assert abs((s[i] == s[j]).mean() - len(x & y) / len(x | y)) < 0.05
        sets = [set(cell_array(c).tolist()) for c in cells_of(gram, count, of, 3)]
        assert [len(c) for c in sets] == [len(cells(t)) for t in (a, b, "again and " * 200 + a)] and len(sets[0] & sets[1]) == len(cells(a) & cells(b))
    gram, count, of, _ = shingles(["single", None, "word " * 300000])
    assert count.max() > 10**5 and len(gram) == 2
    s = dartminhash.signatures(gram, count, of, 3)
    assert (s[0] != 0).all() and (s[1] == 0).all() and (s[2] != 0).all()


# 5 nearest neighbours --------------------------------------------------------------------------------------------------


def test_hilbert_curve_is_a_curve():
    g = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    k = hilbert.hilbert(g, 3)
    assert sorted(k) == list(range(512)) and (np.abs(np.diff(g[np.argsort(k)], axis=0)).sum(axis=1) == 1).all()


def test_search_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 16)) * 0.2).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:130] = x[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [None] * 16, 0), (2060, [float("nan")] * 16, 0), (2080, [float("inf")] * 16, 0), (2100, [1.0], 0), (None, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, rank int")
    out = collections.defaultdict(list)
    for r in hilbert.search(df, F.col("vec_id") % 20 == 0).collect():
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(out) == set(range(0, 1500, 20))
    hit = total = 0
    for q, got in out.items():
        got.sort()
        exact = (x.astype(float) * x[q].astype(float)).sum(axis=1)
        i = sorted((j for j in range(1500) if j != q), key=lambda j: (-exact[j], j))[:20]
        assert all(s == pytest.approx(exact[v], abs=1e-12) for _, v, s in got)
        assert [r for r, _, _ in got] == list(range(1, 21)) and q not in {v for _, v, _ in got}
        hit, total = hit + len(set(i) & {v for _, v, _ in got}), total + 20
    assert hit / total >= 0.9
    assert [v for _, v, _ in out[120]][:19] == [v for v in range(100, 119)]
    few = hilbert.search(spark.createDataFrame(rows[:3], "vec_id bigint, embedding array<float>, rank int"), F.col("vec_id") == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]
    assert hilbert.search(df.where("vec_id < 0"), F.lit(True)).count() == 0


# 6 personal data -------------------------------------------------------------------------------------------------------


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


PRIVATE = ["a@b@c.d x@y.z_w@q.r", f"{pii.SENTINEL}..@a.b{pii.SENTINEL}", "1.2.3.4.5.6.7.8", "0255.1.1.1 256.1.1.1", "card 4111 1111 1111 1111", "+1 (612) 555-4887 4111-1111-1111-1111", "é\U0001f600 x@y.zz", "9" * 30000, "+1" + "(" * 30000, "a.b" * 20000, "..a@b.c..d@e.f", "+1 2+3 4444444444"]


def test_pii_against_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*PRIVATE, *TEXTS])], "doc_id bigint, text string")
    for r in pii.find_pii(df).select("text", pii.span_text(F.col("pii")).alias("s")).collect():
        got = [tuple(x.split(":")) for x in r["s"].split(",") if x and not x.startswith(("iban", "ssn"))]
        assert got == [(k, str(a), str(b)) for k, a, b in base_spans(r["text"] or "")]


def test_pii_checksums_context_and_redaction(spark):
    df = spark.createDataFrame([("GB82 WEST 1234 5698 7654 32",), ("GB82 WEST 1234 5698 7654 33",), ("my card 4111111111111111",), ("xx 4111111111111111, a@b.cd",), (None,)], "text string")
    out = [r["pii"] for r in pii.find_pii(df.withColumn("pii", F.lit(1))).collect()]
    assert [s["kind"] for s in out[0]] == ["iban"] and out[1] == [] and out[4] == []
    assert out[2][0]["score"] > [s for s in out[3] if s["kind"] == "card"][0]["score"]
    assert [r["text"] for r in pii.redact(df).collect()] == ["[IBAN]", "GB82 WEST 1234 5698 7654 33", "my card [CARD]", "xx [CARD], [EMAIL]", None]
    assert pii.find_pii(frame(spark, empty=True)).count() == 0


def test_pii_query_against_python(spark, tmp_path):
    texts = [*PRIVATE, "GB82WEST12345698765432 and 078-05-1120", None, "a@b.cd " * 700 + "1.2.3.4"]
    spark.createDataFrame([(2**60 + i, t) for i, t in enumerate(texts)] + [(None, "x@y.zz")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in pii.op6_pii(spark, str(tmp_path)).collect()}
    assert got[None]["n_email"] == 1 and len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        r, want = got[2**60 + i], base_spans(t or "")
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in want) for k in ("email", "ip", "card", "phone")]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        more = [s for s in r["spans"].split(",") if s.startswith(("iban", "ssn"))]
        assert more == (["iban:0:22", "ssn:27:38"] if i == len(PRIVATE) else [])


def test_redaction_keeps_other_characters_and_minds_the_score(spark):
    texts = [f"{pii.SENTINEL}a@b.cd{pii.SENTINEL}", f"{pii.SENTINEL} 1.2.3.4 \U0001f600", "ssn 078-05-1120", "so 078-05-1120", "\ue001 x"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r["text"] for r in pii.redact(df).collect()] == [f"{pii.SENTINEL}[EMAIL]{pii.SENTINEL}", f"{pii.SENTINEL} [IP] \U0001f600", "ssn [SSN]", "so [SSN]", "\ue001 x"]
    assert [r["text"] for r in pii.redact(df, least=0.65).collect()][2:4] == ["ssn [SSN]", "so 078-05-1120"]
    assert [r["text"] for r in pii.redact(df, least=1.1).collect()] == texts


# 7 mixing --------------------------------------------------------------------------------------------------------------


def test_mixing_stays_within_a_block(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "x" * int(rng.integers(1, 400)), f"s{min(3, int(rng.exponential(1)))}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    weights = {"s0": 0.5, "s1": 0.2, "s2": 0.2, "s3": 0.1}
    out = mixing.mix(df, weights, block=1000).collect()
    assert len(out) == 3000
    last = max(r["mix_slot"] for r in out if r["in_mix"])
    slots = {(r["source"], r["mix_block"]): r["mix_slot"] for r in out}
    for s, w in weights.items():
        for (name, b), slot in slots.items():
            if name == s:
                assert math.floor(b / w + 1e-9) <= slot <= math.ceil((b + 1) / w - 1e-9) - 1  # released, and before its deadline
    for t in range(0, last, 37):
        for s, w in weights.items():
            done = len({b for (name, b), slot in slots.items() if name == s and slot < t})
            assert abs(done - w * t) < 1


def test_mixing_of_long_documents_and_a_tiny_source(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "x" * int(rng.integers(1, 9000)), f"s{i % 2}") for i in range(600)] + [(None, "hi", "tiny"), (None, "ho", "tiny")]
    weights = {"s0": 0.6, "s1": 0.399, "tiny": 0.001}
    out = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), weights, block=1000).collect()
    slots = {(r["source"], r["mix_block"]): r["mix_slot"] for r in out}
    blocks = {s: sorted(b for name, b in slots if name == s) for s in weights}
    assert all(b == list(range(len(b))) for b in blocks.values())  # no block is passed over by a document that spans it
    assert len(out) == 602 and sum(r["in_mix"] for r in out) > 400
    last = max(r["mix_slot"] for r in out if r["in_mix"])
    for s in ("s0", "s1"):
        for t in range(0, last, 7):
            assert abs(sum(1 for b in blocks[s] if slots[s, b] < t) - weights[s] * t) < 1


def test_mixing_odd_rows(spark):
    df = frame(spark).withColumn("mix_slot", F.lit("x"))
    out = mixing.mix(df, block=100)
    assert out.count() == len(TEXTS) + 2 and out.where("mix_slot is null").count() == 0 and out.where("in_mix").count() > 0
    assert mixing.mix(df, {"s1": 1.0}).where("source = 's2' and in_mix").count() == 0
    assert mixing.mix(frame(spark, empty=True)).count() == 0


def test_mixing_of_more_sources_than_slots(spark):
    rows = [(i, "x" * (90 if i % 1300 == 7 else 10), f"s{i % 1300}") for i in range(3900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for weights in (None, {f"s{i}": 500.0 if i == 7 else 1.0 for i in range(1300)}):
        out = mixing.mix(df, weights, block=10).collect()
        assert len(out) == 3900 and all(r["mix_slot"] is not None for r in out)
        slots = {(r["source"], r["mix_block"]): r["mix_slot"] for r in out}
        assert len(set(slots.values())) == len(slots) and max(slots.values()) < 5200 * 27
        assert {s for s, _ in slots} == {f"s{i}" for i in range(1300)}
    crowded = mixing.mix(df.where("doc_id < 30"), {f"s{i}": 1000.0 if i == 7 else 1.0 for i in range(30)}, block=10, slots=30).collect()
    assert len(crowded) == 30 and all(r["mix_slot"] is not None for r in crowded)


def test_schedule_equals_period(spark):
    shares = [("a", 3), ("b", 17), ("c", 1), ("d", 40), ("e", 39)]
    df = spark.createDataFrame(shares, "__source string, w bigint")
    want = sorted((ord(r["__source"]) - 97, r["k"], r["slot"]) for r in mixing.period(df, 100).collect())
    assert sorted(mixing.schedule([w for _, w in shares], 100)) == want and len(want) == 100


# 8 language ------------------------------------------------------------------------------------------------------------


def test_language_learns_and_rejects(spark):
    rng = np.random.default_rng(0)
    words = {"xx": "thar bolin grath merk".split(), "yy": "éçou tréne ouaix lèque".split(), "zz": "ñando círo gueza llorí".split()}
    make = lambda lang: " ".join(rng.choice(words[lang], 60))
    texts, labels = zip(*[(make(lang), lang) for lang in list(words) * 60], strict=True)
    m = langid.train(list(texts), list(labels))
    lang, score, ok = m.predict([make("xx"), make("yy"), make("zz"), None, "", "123 --", "\U0001f600"])
    assert lang == ["xx", "yy", "zz", "und", "und", "und", "und"] and ok.tolist() == [True] * 3 + [False] * 4 and (score[3:] == 0).all()
    out = langid.identify(frame(spark).withColumn("lang_pred", F.lit(1)), m)
    assert out.count() == len(TEXTS) + 2 and out.where("text is null and lang_pred <> 'und'").count() == 0
    assert langid.identify(frame(spark, empty=True), m).count() == 0 and langid.train([], []).predict(["a"])[0] == ["und"]


def test_language_query_on_held_out_rows(spark):
    import pandas as pd

    rows = langid.op8_language(spark, "/root/testdata/sf0.01").toPandas()
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    both = rows.merge(docs, on="doc_id")
    assert len(both) == len(docs) == len(rows) and all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(rows.doc_id, rows.held_out, strict=True))
    letter = both.text.fillna("").map(lambda t: any(c.isalpha() for c in t))
    assert set(both.lang_pred[letter]) <= set(docs.lang.dropna()) and (both.lang_pred[~letter] == "und").all() and rows.score.between(0, 1).all()
    known = both[both.held_out & letter & both.lang.notna()]
    assert (known.lang_pred == known.lang).mean() > 0.97


def test_language_learns_from_bounded_passages(spark):
    df = spark.createDataFrame([(i, ("thar bolin grath merk " if i % 2 else "éçou tréne ouaix lèque ") * 200, "xx" if i % 2 else "yy") for i in range(60)], "doc_id bigint, text string, lang string")
    m = langid.fit(df, limit=40, passages=100)
    assert m.langs == ["xx", "yy"] and m.predict(["bolin thar", "ouaix éçou"])[0] == ["xx", "yy"]
    assert np.array_equal(m.table, langid.fit(df.repartition(3), limit=40, passages=100).table) and langid.fit(df.where("false")).langs == []


# 9 fingerprints --------------------------------------------------------------------------------------------------------


def test_fingerprint_keeps_rightmost_minima_and_guarantee(spark):
    df = winnow.with_fingerprint(frame(spark), "text", "fp").select("doc_id", "text", "fp")
    got = {r["doc_id"]: r for r in df.where("doc_id is not null").collect()}
    assert got[0]["fp"] == got[1]["fp"] == [] and got[4]["fp"] == got[5]["fp"]
    all_ = winnow.with_fingerprint(frame(spark), "text", "fp", window=1).where("doc_id = 6").first()["fp"]
    keys = list(all_)
    want = []
    for i in range(len(keys) - winnow.WINDOW + 1):
        part = keys[i : i + winnow.WINDOW]
        low = min(k >> 31 for k in part)
        pick = [k for k in part if k >> 31 == low][-1]
        if not want or want[-1] != pick:
            want.append(pick)
    assert got[6]["fp"] == want
    run = " ".join(PROSE[3].split()[10 : 10 + winnow.K + winnow.WINDOW - 1])
    two = spark.createDataFrame([(0, f"{PROSE[4]} {run} {PROSE[5]}"), (1, f"{PROSE[6]} {run} {PROSE[7]}")], "doc_id bigint, text string")
    a, b = (r["fp"] for r in winnow.with_fingerprint(two, "text", "fp").collect())
    assert {x >> 31 for x in a} & {x >> 31 for x in b}


def test_fingerprints_of_short_and_long_texts_share_hashes(spark):
    words = PROSE[3].split()
    texts = [" ".join(words[:15]), " ".join(words[:16]), " ".join(words[:9]), f"{PROSE[4]} {' '.join(words[:9])} {PROSE[5]}"]
    df = winnow.with_fingerprint(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "text", "fp")
    fp = {r["doc_id"]: {x >> 31 for x in r["fp"]} for r in df.collect()}
    assert len(fp[0] & fp[1]) >= 0.5 * len(fp[0] | fp[1]) and fp[2] & fp[3]


def test_next_documents(spark, tmp_path):
    ids = [5, 7, 300, 301, 900, 70000, 70001, 9_000_000, -4]
    df = spark.createDataFrame([(i, f"text of {i} " * 3) for i in ids], "doc_id bigint, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in winnow.op9_fingerprints(spark, str(tmp_path)).collect()}
    order = sorted(ids, reverse=True)
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        t, u = f"text of {a} " * 3, f"text of {b} " * 3
        k = len(t) // 3
        assert got[a]["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + u[:k]).encode()).hexdigest() and 0 <= got[a]["near_edited"] <= 1


def plain_fingerprint(text):
    """Hashes (as the operator makes them, token by token) by position, by definition."""
    import xxhash

    alone = "\u0e00-\u0e7f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
    tokens = re.findall(rf"[^\W_{alone}]{{1,16}}|[{alone}]", text.lower()) or re.findall(r"\S", text)
    hashed = lambda data, seed: xxhash.xxh64_intdigest(data, seed)
    long = lambda h: h.to_bytes(8, "little")
    join = lambda a, b: hashed(long(b), hashed(long(a), 42)) if b is not None else hashed(long(a), 42)
    one = [hashed(t.encode(), 42) for t in tokens]
    two = [join(h, one[i + 1] if i + 1 < len(one) else None) for i, h in enumerate(one)]
    four = [join(h, two[i + 2] if i + 2 < len(two) else None) & 0xFFFFFFFF for i, h in enumerate(two)]
    four = four[: max(1, len(four) - 3)]
    out = []
    for i in range(max(1, len(four) - 5) if four else 0):
        low = min(four[i : i + 6])
        at = max(j for j in range(i, min(i + 6, len(four))) if four[j] == low)
        if (low, at) not in out:
            out.append((low, at))
    return out


def test_fingerprint_query_against_definition(spark, tmp_path):
    big = 2**60 + 1
    rows = [(big, PROSE[2]), (big - 1, PROSE[3] + " 漢字と kana"), (9, PROSE[2] + " and some more"), (3, None), (2, "!!! ???"), (1, "a b c d e"), (0, "one"), (-7, PROSE[4] * 3), (-7, PROSE[5]), (None, PROSE[6]), (None, PROSE[7])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, bucket string, cut int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = winnow.op9_fingerprints(spark, str(tmp_path)).collect()
    order = sorted(((-(2**62) if i is None else i, t or "") for i, t in rows), key=lambda r: (-r[0], r[1]))
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    want = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        k = len(t) // 3
        edited = t[: len(t) - k] + u[:k]
        a, b, c = (plain_fingerprint(x) for x in (t, edited, u))
        show = lambda f: ",".join(f"{h:x}:{p}" for h, p in f)
        hs = [{h for h, _ in f} for f in (a, b, c)]
        want.append((None if i == -(2**62) else i, len(t), hashlib.sha256(edited.encode()).hexdigest(), show(a), show(b), like(hs[0], hs[1]), like(hs[0], hs[2])))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert winnow.op9_fingerprints(spark, str(tmp_path / "none")).count() == 0


# 10 packing ------------------------------------------------------------------------------------------------------------


def test_encoder_equals_tokenizer():
    e = Encoder(packing.vocabulary())
    texts = [*(t for t in TEXTS if t), "it's a test's ' s don''t", "a<|endoftext|>b", "Ünïcödé Σας", "\x1c a\x85b", "x" * 3000, "<b>!!it'll</b> we'd've", "ǅ İ ŉ", "abc123def 4,5"]
    for t, b in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(b, "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_gapless_and_close_to_least(seed):
    rng = np.random.default_rng(seed)
    cap = int(rng.choice([16, 100, 4096]))
    h = collections.Counter(np.clip(rng.exponential(cap * rng.uniform(0.05, 0.6), int(rng.choice([0, 3, 400, 20000]))).astype(int) + 1, 1, cap).tolist())
    p = packing.plan(h, cap)
    use = collections.defaultdict(list)
    for n, c in h.items():
        s, o = p.place(n, np.arange(c))
        for a, b in zip(s.tolist(), o.tolist(), strict=True):
            use[a].append((b, n))
    for v in use.values():
        at = 0
        for b, n in sorted(v):
            assert b == at
            at += n
        assert at <= cap
    least = -(-sum(n * c for n, c in h.items()) // cap)
    assert len(use) == p.sequences <= max(least + 3, 1.03 * max(least, sum(c for n, c in h.items() if n > cap / 2)) + 3)


def test_pack_rows(spark):
    out = packing.pack(frame(spark), packing.vocabulary(), ids=True).collect()
    e = Encoder(packing.vocabulary())
    by = collections.defaultdict(list)
    for r in out:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        by[r["doc_id"]].append(r)
    for i, t in enumerate(TEXTS):
        want = [*(e.tokenizer.encode(t, add_special_tokens=False).ids if t else []), 1]
        parts = sorted(by[i], key=lambda r: r["piece"])
        if i != 4:  # doubled
            assert np.frombuffer(b"".join(bytes(r["ids"]) for r in parts), "<u4").tolist() == want
    seqs = collections.defaultdict(list)
    for r in out:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in seqs.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(v), sorted(v)[1:], strict=False)) and sum(n for _, n in v) <= 4096
    assert packing.pack(frame(spark, empty=True), packing.vocabulary()).count() == 0


# All ---------------------------------------------------------------------------------------------------------------------


def test_large_ids_beside_nulls_stay_exact(spark):
    big = [2**60 + 1, 2**60 + 3, None, 2**53 + 1]
    df = spark.createDataFrame([(i, f"{PROSE[k]} {k}", "en", 2**61 + 1 if k else None) for k, i in enumerate(big)], "doc_id bigint, text string, lang string, other bigint").coalesce(1)
    ids = lambda rows, c="doc_id": sorted((r[c] for r in rows), key=str)
    want = sorted(big, key=str)
    model = quality.train([PROSE[0], "!!! x"] * 4, [1, 0] * 4, epochs=1)
    assert ids(quality.score(df, model).collect()) == want and ids(quality.score(df, model).collect(), "other") == sorted([None, *[2**61 + 1] * 3], key=str)
    assert ids(langid.identify(df, langid.train([PROSE[0], PROSE[1]], ["en", "de"])).collect()) == want
    assert ids(dartminhash.near_duplicates(df).collect()) == want == ids(dartminhash.near_duplicates(df).collect(), "class_id")
    assert ids(dartminhash.deduplicate(df).collect()) == want
    assert ids(packing.pack(df, packing.vocabulary()).collect()) == want
    assert ids(mincut.extract(df.withColumnRenamed("text", "html")).collect()) == want
    assert ids(rollup.count_tokens(df, {"text": "n"}, packing.vocabulary()).collect()) == want
    vectors = spark.createDataFrame([(i, [1.0, float(k)]) for k, i in enumerate(big)], "vec_id bigint, embedding array<float>").coalesce(1)
    assert {r["vec_id"] for r in hilbert.search(vectors, F.lit(True)).collect()} == set(big) - {None}


def test_words_kept_by_a_worker_stay_few():
    import sys

    from strandlake.llm.packing import vocabulary
    from strandlake.llm.tokens import Encoder

    e = Encoder(vocabulary())
    for a in range(0, 400_000, 20_000):
        e.encode([" ".join(f"w{i}" for i in range(a, a + 20_000))])
    assert sys.getsizeof(e.kept) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in e.kept.items()) < 40e6
