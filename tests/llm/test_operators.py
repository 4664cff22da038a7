"""Each operator against brute force, on the awkward documents and on an empty table."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import html_extraction, lm_scoring, near_dedup, packing, quality_classifier, quality_rules, source_mixing, substring_dedup, suffix_dedup
from quillon.llm.exact_dedup import chunk_ends, exact_groups, keep_first

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
BIG = float("inf")


def words(t):
    return WORD.findall(t or "")


def low(t):
    return (t or "").translate(LOWER)


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def bag(df, *cols):
    return collections.Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_substring(docs, rows, none):
    first = {}
    for d, t, *_ in rows:
        w, key = words(t), BIG if d is None else d
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(first.get(tuple(w[k : k + 13]), BIG), key)
    want = collections.Counter()
    for d, t, *_ in rows:
        w, gone = words(t), set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < (BIG if d is None else d):
                gone |= set(range(k, k + 13))
        want[d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))] += 1
    assert bag(substring_dedup.remove_repeated_windows(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert substring_dedup.remove_repeated_windows(none).count() == 0


@pytest.mark.parametrize("length", [400, 60])
def test_suffix(docs, rows, none, length):
    raw = [(d, (t or "").encode()) for d, t, *_ in rows]
    seen = collections.Counter(t[p : p + length] for _, t in raw for p in range(len(t) - length + 1))
    want = collections.Counter()
    for d, t in raw:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        want[d, len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone, strict=True) if not g))] += 1
    assert bag(suffix_dedup.remove_repeated_strings(docs, length), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    if length == 400:
        assert suffix_dedup.remove_repeated_strings(none).count() == 0


class AnyOrder:
    """A grouped table whose functions get each group's rows in an order that changes whenever they run, as from several executors."""

    def __init__(self, grouped):
        self.grouped = grouped

    def cogroup(self, other):
        return AnyOrder(self.grouped.cogroup(other.grouped))

    def applyInArrow(self, f, schema):
        mixed = lambda t: t.take(np.random.default_rng().permutation(len(t)))
        n = f.__code__.co_argcount - len(f.__defaults__ or ())
        if n == 1:
            return self.grouped.applyInArrow(lambda t: f(mixed(t)), schema)
        if n == 2:
            return self.grouped.applyInArrow(lambda key, t: f(key, mixed(t)), schema)
        return self.grouped.applyInArrow(lambda key, t, u: f(key, mixed(t), mixed(u)), schema)


def test_suffix_rows_in_any_order(spark, monkeypatch):
    """Passages that some texts hold with equal ends, in several blocks, and others with other ends."""
    r = random.Random(3)
    some = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    texts = []
    for _ in range(12):
        passage = some(900)
        texts += [passage] * 4 + [some(r.randint(1, 90)) + passage[r.randint(0, 300) :] + some(r.randint(1, 90)) for _ in range(4)] + [passage[40:470] + some(200)]
    sized, grouped = suffix_dedup.B.sized, type(spark.range(0)).groupBy
    monkeypatch.setattr(suffix_dedup.B, "sized", lambda *a: sized(*a, block_bytes=4000))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(type(df), "groupBy", lambda self, *by: AnyOrder(grouped(self, *by)) if by in (("block",), ("bucket",)) else grouped(self, *by))
    out = suffix_dedup.remove_repeated_strings(df, with_text=True)
    seen = collections.Counter(t[p : p + 400] for t in texts for p in range(len(t) - 399))
    for d, *got in out.select("doc_id", "n_removed", "kept_bytes").collect():
        t = texts[d]
        gone = {q for p in range(len(t) - 399) if seen[t[p : p + 400]] > 1 for q in range(p, p + 400)}
        assert got == [len(gone), "".join(c for q, c in enumerate(t) if q not in gone).encode()], d


def test_mixing_weights():
    tokens = [1000, 100, 10]
    shares = [t / 1110 for t in tokens]
    e = source_mixing.find_exponent(tokens, target_entropy=0.9)
    assert source_mixing.entropy(source_mixing.weights(shares, e)) == pytest.approx(0.9, abs=1e-6)
    e = source_mixing.find_exponent(tokens, most_repeats=4.0)
    assert max(source_mixing.repeats(tokens, source_mixing.weights(shares, e), None)) == pytest.approx(4.0, abs=1e-6)
    assert source_mixing.find_exponent(tokens, target_entropy=5.0) == 0.0


def test_mixing(docs, rows, none):
    got = source_mixing.mixing_report(docs, most_repeats=3.0, block_docs=5).collect()
    passes = collections.defaultdict(collections.Counter)
    for r in got:
        passes[r["source"], r["pass"]][r["doc_id"]] += 1
    for s in {r[3] for r in rows}:
        own = collections.Counter(r[0] for r in rows if r[3] == s)
        total = sum(len(words(r[1])) for r in rows if r[3] == s)
        mine = [r for r in got if r["source"] == s]
        last = max(r["pass"] for r in mine)
        for p in range(last):
            assert passes[s, p] == own  # whole passes hold every document once
        share = mine[0]["weight"]
        quota = share * sum(r["n_tokens"] for r in got)
        assert abs(sum(r["n_tokens"] for r in mine) - quota) < 9500 and last <= 3 and total >= 0
    assert {r["doc_id"] for r in got} == {r[0] for r in rows}
    for p in {r["pass"] for r in got}:  # a block's rows have one turn; turns differ by block
        turns = collections.defaultdict(set)
        for r in got:
            if r["pass"] == p:
                turns[r["block"]].add(r["turn"])
        assert all(len(t) == 1 for t in turns.values()) and len({min(t) for t in turns.values()}) == len(turns)
    many, _ = source_mixing.mix_sources(docs, target_entropy=1.0)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    w = source_mixing.weights([v / sum(sizes.values()) for v in sizes.values()], source_mixing.find_exponent(list(sizes.values()), target_entropy=1.0))
    assert {r["source"]: round(r["mix_weight"], 9) for r in many.collect()} == {k: round(x, 9) for k, x in zip(sizes, w, strict=True)}
    capped, _ = source_mixing.mix_sources(docs, budget=2000, most_repeats=5.0)
    assert capped.columns[: len(docs.columns)] == docs.columns
    assert sum(r["mix_tokens"] for r in capped.collect()) <= 2005
    assert source_mixing.mixing_report(none).count() == 0


def base(t):
    w = words(t)
    tri = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    again = {k + i for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for i in range(3)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


def test_quality_rules(docs, rows, none):
    out = quality_rules.judge(docs)
    want = collections.Counter((r[0], *base(r[1])) for r in rows)
    assert bag(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert not [r for r in out.collect() if r["base_failed"] and r["kept"]]
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert bag(kept, "doc_id") == bag(out.filter("kept"), "doc_id")
    assert quality_rules.judge(none).count() == 0 and quality_rules.keep_good(none).count() == 0


def test_em_finds_junk():
    patterns = np.array([[1, 1, 1], [2, 1, 1], [1, 2, 1], [0, 1, 1], [1, 1, 2]])
    share, acc, post = quality_rules.fit_accuracies(patterns, np.array([900.0, 40, 30, 20, 10]))
    assert post[0] > 0.9 and post[3] > 0.9 and max(post[1], post[2], post[4]) < 0.3
    assert share.sum() == pytest.approx(1) and acc.shape == (3, 4)


PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=x>Menu</a></ul></nav><div class=\"ad\">Buy</div>{body}<footer>&copy; us</footer>"


def main_text(html, template=frozenset()):
    tree = html_extraction.parse(html)
    return "\n".join(x for at, x in (tree.blocks[k] for k in html_extraction.candidates(tree)) if tree.fingerprint(at, x) not in template)


def test_html_rules():
    text = lambda body: main_text(PAGE.format(body=body))
    assert text("<article><h1>A &amp; B</h1><p><b>one\n two<br><p>three</article>") == "A & B\none two\nthree"
    assert text("<article><p>body<aside>x</aside><div class='comments'><p>nice</div><form><p>f</form><p>end</article>") == "body\nend"
    assert text("<div><p>only</p></div>") == "only"
    assert text("") == ""
    assert main_text("") == ""


def best_matching(a, b):
    """Size of the largest matching, by plain recursion."""
    kids = lambda t: [[c for c, p in enumerate(t[0]) if p == i] for i in range(len(t[0]))]
    ka, kb = kids(a), kids(b)

    def weigh(i, j):
        if a[1][i] != b[1][j]:
            return 0
        m = [[0] * (len(kb[j]) + 1) for _ in range(len(ka[i]) + 1)]
        for x, p in enumerate(ka[i]):
            for y, q in enumerate(kb[j]):
                m[x + 1][y + 1] = max(m[x][y + 1], m[x + 1][y], m[x][y] + weigh(p, q))
        return 1 + m[-1][-1]

    return weigh(0, 0)


@pytest.mark.parametrize("table", [1 << 20, 4])
def test_tree_matching(monkeypatch, table):
    monkeypatch.setattr(html_extraction, "TABLE", table)
    rng = np.random.default_rng(8)

    def tree(n):
        depth_first = [-1]
        path = [0]
        for i in range(1, n):
            del path[int(rng.integers(1, len(path) + 1)) :]
            depth_first.append(path[-1])
            path.append(i)
        return depth_first, [0, *rng.integers(0, 3, n - 1).tolist()]

    for _ in range(150):
        a, b = tree(int(rng.integers(1, 14))), tree(int(rng.integers(1, 14)))
        pairs = html_extraction.simple_tree_matching(a, b)
        assert len(pairs) == best_matching(a, b)
        up = dict(pairs)
        assert len(up) == len(pairs) == len(set(up.values()))
        for i, j in pairs:
            assert a[1][i] == b[1][j] and (i == 0 or up[a[0][i]] == b[0][j])
        same_parent = [(x, y) for x in pairs for y in pairs if x[0] < y[0] and a[0][x[0]] == a[0][y[0]]]
        assert all(x[1] < y[1] for x, y in same_parent)
        assert len(html_extraction.simple_tree_matching(a, a)) == len(a[0])


def test_html_deep_and_wide():
    deep = html_extraction.parse("<div>" * 20_000 + "x")
    wide = html_extraction.parse("<ul>" + "".join(f"<li>{i}" if i % 3 else "<p>q</p>" for i in range(9000)) + "</ul>")
    other = html_extraction.parse("<ul>" + "".join(f"<li>{i}" if i % 5 else "<p>q</p>" for i in range(8000)) + "</ul>")
    assert html_extraction.candidates(deep) == [0] and deep.blocks == [(20_000, "x")]
    for x, y in ((deep, deep), (wide, other)):
        a, b = html_extraction.skeleton(x), html_extraction.skeleton(y)
        assert len(html_extraction.simple_tree_matching(a[:2], b[:2])) > 5000


def test_html_template(spark):
    made = [(i, "http://h.example/" + str(i), PAGE.format(body=f"<article><h1>Title {i}</h1><p>Story {i} {'w' * i}</p><p>Read more on our site</p><div>Footer start<p>mid</p>Footer end</div></article>")) for i in range(12)]
    made += [(50, None, None), (51, "http://h.example/x", ""), (52, "http://other.example/", PAGE.format(body="<article><p>Read more on our site</p></article>")), (0, made[0][1], made[0][2])]
    # A layout on a minority of a host's pages, and a host of three pages.
    made += [(100 + i, "http://two.example/" + str(i), PAGE.format(body=f"<article><p>Text {i}</p></article>")) for i in range(9)]
    made += [(120 + i, "http://two.example/g" + str(i), PAGE.format(body=f"<article><section><p>Text {i}</p><p>Gallery note</p></section></article>")) for i in range(4)]
    made += [(140 + i, "http://three.example/" + str(i), PAGE.format(body=f"<article><p>Text {i}</p><p>Note</p></article>")) for i in range(3)]
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    made += [(150 + i, "http://deep.example/" + str(i), f"<article><p>n {i}</p>{deep}</article>") for i in range(3)]
    df = spark.createDataFrame([(*r, "x", 7) for r in made], "page_id long, url string, html string, host string, layout int")
    rows = html_extraction.extract_main_text(df).collect()
    got = {(r["page_id"], r["url"]): r for r in rows}
    assert len(rows) == len(made)
    assert got[3, "http://h.example/3"]["text"] == "Title 3\nStory 3 www"  # constant blocks are template, several in one node too
    assert got[52, "http://other.example/"]["text"] == "Read more on our site"  # one page tells nothing
    assert got[50, None]["text"] == "" and got[50, None]["n_chars"] == 0
    assert got[103, "http://two.example/3"]["text"] == "Text 3" and got[122, "http://two.example/g2"]["text"] == "Text 2"
    assert got[141, "http://three.example/1"]["text"] == "Text 1" and got[151, "http://deep.example/1"]["text"] == "n 1"
    assert html_extraction.extract_main_text(df.limit(0)).count() == 0


def test_exact(docs, rows, none):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for d, t, *_ in rows:
        groups[norm(t)].append(d)
    want = collections.Counter()
    for t, ids in groups.items():
        keep = min((d for d in ids if d is not None), default=None)
        first = True
        for d in sorted(ids, key=lambda d: BIG if d is None else d):
            want[d, keep, len(ids), d == keep and first, sha(t)] += 1
            first = first and d != keep
    assert bag(exact_groups(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    kept = keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_groups(none).count() == 0 and keep_first(none).count() == 0


def test_whole_rows_stay(spark, tmp_path):
    """Rows with texts aren't exchanged to drop or repeat a few of them, even if the ids of those that stay are too many to broadcast."""
    r = random.Random(7)
    texts = [" ".join(f"w{r.randrange(5000)}" for _ in range(12)) for _ in range(4000)]
    texts += texts[:3] + [f"{t} more" for t in texts[3:6]]
    rows = [(r.randrange(1 << 60), t, f"s{i % 3}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "12k")
    try:
        df.write.parquet(f"{tmp_path}/rows")
        read = spark.read.parquet(f"{tmp_path}/rows")
        for out, n in ((keep_first(read), 4003), (near_dedup.keep_one(read), 4000), (source_mixing.mix_sources(read)[0].select(*df.columns), 4006)):
            assert not re.search("SortMergeJoin|Exchange hashpartitioning", out._jdf.queryExecution().executedPlan().toString())
            assert len({x["doc_id"] for x in out.collect()}) == n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_mixing_ties(spark):
    """Of rows that tie in id and tokens as many are in the last pass as fit, and a row counts once a pass."""
    df = spark.createDataFrame([(i % 4, "a b c", "s") for i in range(40)], "doc_id long, text string, source string")
    for budget in (30, 75, 117, 120, 200):
        got, names = source_mixing.mix_sources(df, budget=budget, most_repeats=None)
        passes = collections.Counter(x[names["pass"]] for x in got.collect())
        assert passes == collections.Counter({p: min(40, budget // 3 - 40 * p) for p in range(-(-(budget // 3) // 40))})


def test_chunks_are_local():
    a = bytes(np.random.default_rng(1).integers(97, 123, 5000, np.uint8))
    cut = lambda t: {t[x:y] for x, y in zip([0, *chunk_ends(t, 64)], chunk_ends(t, 64), strict=False)}
    assert b"".join(a[x:y] for x, y in zip([0, *chunk_ends(a, 64)], chunk_ends(a, 64), strict=False)) == a
    assert len(cut(a) - cut(b"prefix" + a)) <= 2


def test_classifier(spark, docs, rows, none):
    labels = [(r[0], int(not base(r[1])[5])) for r in rows if r[0] is not None] + [(None, 1), (5, None)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality_classifier.score_quality(docs, lab).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 4 == 2)
    assert quality_classifier.score_quality(none, lab).count() == 0
    assert {r["score"] for r in quality_classifier.score_quality(docs, lab.limit(0)).collect()} == {0.5}


def test_additive_model_learns_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_classifier.fit(x[:3000], y[:3000], rounds=30, pair_rounds=80)
    assert ((model.score(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean() > 0.95
    z = model.log_odds(model.bins(x[:5]))
    by_hand = [model.intercept + sum(t[b] for t, b in zip(model.tables, row, strict=True)) + sum(t[row[i], row[j]] for (i, j), t in model.pairs.items()) for row in model.bins(x[:5])]
    assert np.allclose(z, by_hand)


def shingles(t):
    w = words(low(t))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def near_components(items):
    """items: (id, text) with ids. Brute force over all pairs."""
    sets, up = {d: shingles(t) for d, t in items}, {d: d for d, _ in items}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: find(d) for d in ids}


def test_near(docs, rows, none):
    comp = near_components([(r[0], r[1]) for r in rows if r[0] is not None])
    want = collections.Counter((r[0], len(shingles(r[1])), comp.get(r[0]), r[0] == comp.get(r[0])) for r in rows)
    assert bag(near_dedup.near_groups(docs), "doc_id", "n_shingles", "component_id", "kept") == want
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted(set(comp.values()))
    assert kept.filter("doc_id is null").count() == sum(r[0] is None for r in rows)
    assert near_dedup.near_groups(none).count() == 0


@pytest.mark.parametrize("confirm,few", [(1 << 12, 10**6), (1 << 25, 0)])
def test_near_in_small_parts(docs, rows, monkeypatch, confirm, few):
    """Groups larger than a confirming task, and texts found by a shuffle."""
    monkeypatch.setattr(near_dedup, "CONFIRM", confirm)
    monkeypatch.setattr(near_dedup, "FEW", few)
    comp = near_components([(r[0], r[1]) for r in rows if r[0] is not None])
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(docs).collect() if r["doc_id"] is not None} == comp


def test_equal_ids_and_taken_names(spark):
    """Rows with an equal id: one stays. Columns named like those made inside come back as they were."""
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(70))
    rows = [(1, text(1), "a", "mine"), (1, text(1), "a", "mine"), (2, text(2), "a", "mine"), (None, text(3), "a", "mine"), (None, text(3), "a", "mine"), (4, None, "a", "mine")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, sha string").select("*", *(F.lit("mine").alias(c) for c in ("own_sha__", "kept_id__", "row", "k", "t", "times", "n_words", "votes", "mix_pass", "bucket", "none")))
    for f, ids in ((exact_groups, None), (keep_first, [None, 1, 2, 4]), (near_dedup.keep_one, [None, None, 1, 2, 4]), (quality_rules.keep_good, [None, None, 1, 1, 2]), (lambda d: source_mixing.mix_sources(d)[0].select(*d.columns), [None, None, 1, 1, 2, 4])):
        out = f(df)
        if ids is not None:
            assert out.columns == df.columns
            got = out.collect()
            assert sorted((r["doc_id"] for r in got), key=repr) == sorted(ids, key=repr) and all(r[c] == "mine" for r in got for c in df.columns[3:])


def test_near_large_nodes(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "NODE", 8)
    monkeypatch.setattr(near_dedup, "SLICE", 6)
    base_words = [f"w{i}" for i in range(200)]
    items = [(i, " ".join(base_words[:i] + [f"x{i}"] + base_words[i + 1 :])) for i in range(60)]
    df = spark.createDataFrame(items, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(df).collect()}
    assert got == near_components(items)


def test_near_large_nodes_without_pivots(spark, monkeypatch):
    """Pairs within a boilerplate group that no pivot resembles: every pair of slices has to be compared."""
    monkeypatch.setattr(near_dedup, "NODE", 16)
    monkeypatch.setattr(near_dedup, "SLICE", 8)
    monkeypatch.setattr(near_dedup, "PIVOTS", 1)
    of = lambda name, n: [f"{name}{k}" for k in range(n)]
    items = [(2 * i + j, " ".join(of("w", 170) + of(f"p{i}x", 6) + of(f"q{i}x{j}x", 28))) for i in range(80) for j in (0, 1)]
    want = near_components(items)
    assert len(set(want.values())) == 80
    df = spark.createDataFrame(items, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(df).collect()} == want


class PlainAutomaton:
    """States, arcs and failure arcs in dictionaries; read one token at a time."""

    def __init__(self, texts, mass):
        self.mass, self.order, self.c = mass, len(mass) + 1, collections.Counter()
        for t in texts:
            s = ["<s>", *t]
            for k in range(1, self.order + 1):
                self.c.update(tuple(s[i : i + k]) for i in range(len(s) - k + 1))
        self.words = {g[0] for g in self.c if len(g) == 1} - {"<s>"}
        self.n = sum(self.c[w,] for w in self.words)

    def p0(self, w):
        return (self.c[w,] * (w != "<s>") + 0.5) / (self.n + 0.5 * (len(self.words) + 1))

    def p(self, state, w):
        if not state:
            return self.p0(w)
        m = self.mass[len(state) - 1]
        return (self.c[*state, w] + m * self.p(state[1:], w)) / (self.c[state] + m)

    def read(self, t):
        state, total = ("<s>",)[: self.order - 1], 0.0
        for w in t:
            while state and not self.c[*state, w]:
                m = self.mass[len(state) - 1]
                total += math.log10(m / (self.c[state] + m))
                state = state[1:]
            total += math.log10(self.p(state, w))
            state = (*state, w)[-(self.order - 1) :] if self.order > 1 else ()
            if state and not self.c[state]:
                state = ()
        return total


@pytest.mark.parametrize("mass", [(60.0, 30.0), (5.0,), (), (3.0, 2.0, 1.0)])
def test_language_model(docs, rows, none, mass, monkeypatch):
    monkeypatch.setattr(lm_scoring, "LANE", 16)
    tok = [[*words(low(r[1])), None] for r in rows]
    train = [zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 5 != 1 for r in rows]
    model = PlainAutomaton([t for t, ok in zip(tok, train, strict=True) if ok], mass)
    want = []
    for r, t, ok in zip(rows, tok, train, strict=True):
        want.append((r[0], not ok, len(t), sum(w in model.words for w in t), model.n, round(sum(math.log10(model.p0(w)) for w in t), 6), round(model.read(t), 6)))
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in lm_scoring.score(docs, mass=mass).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    if mass == (60.0, 30.0):
        assert lm_scoring.score(none).count() == 0
        for state in [(), ("<s>",), *[g for g in model.c if len(g) == 2 and g[-1]][:5]]:  # all known words and one never met
            assert sum(model.p(state, w) for w in [*model.words, "never met"]) == pytest.approx(1)


def test_packing(docs, rows, none):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    ids = {(r[0], r[1]): np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4") for r in rows}
    got = packing.pack(docs, path, size=512, open_windows=4).collect()
    per = collections.defaultdict(int)
    for r in got:
        per[r["sequence_id"]] += r["length"]
    assert max(per.values()) <= 512
    for s in per:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
    want, have = collections.Counter(), collections.Counter()
    for r in rows:
        want[r[0]] += len(ids[r[0], r[1]])
    for r in got:
        have[r["doc_id"]] += r["length"]
        assert any(d == r["doc_id"] and len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for (d, _), x in ids.items())
    assert have == want
    assert sum(per.values()) / (512 * len(per)) > 0.9
    assert packing.pack(none, path).count() == 0


def test_word_encoder_matches_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    import pyarrow as pa

    from quillon.llm import _hashing as H

    path = public.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    texts = ["Don't stop, it's 42!", "ÀÉÎ straße ŒUVRE ΣΑΣ", "é café x y　z", "<|endoftext|> a<|startoftext|>b", "a_b c--d 3.14 ½ Ⅷ", "日本語 テスト 👍🏽", "", "ÃÂ ª º µ ÿ"]
    ids, ptr = packing.encoder(path).encode(*H.text_buffer(pa.array(texts)))
    for i, x in enumerate(texts):
        assert ids[ptr[i] : ptr[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_gap_codes():
    from quillon.llm import _blocks as B

    for v in ([], [5], [1, 2, 3, 1 << 40], sorted({int(x) for x in np.random.default_rng(3).integers(0, 1 << 62, 1000)})):
        a = np.array(v, np.uint64)
        assert B.unpack_gaps(B.pack_gaps(a)).tolist() == a.tolist()
        a = np.repeat(a, np.arange(len(a)) % 3 + 1)
        assert B.unpack_sorted(B.pack_sorted(a)).tolist() == a.tolist()
    for c in ([0, 1, 2, 3, 254, 255, 256, 10**9], [], [1], [7, 0, 0, 0, 3]):
        assert B.unpack_counts(B.pack_counts(np.array(c, np.int64))).tolist() == c


def opposite_texts(n=2048):
    """Thue-Morse strings of a and b: for polynomials modulo a power of two, a string and its opposite collide."""
    t = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return t, t.translate(str.maketrans("ab", "ba"))


def test_opposite_texts(spark):
    """Texts made to collide under rolling fingerprints are told apart by every operator."""
    one, two = opposite_texts()
    texts = [" ".join([*(f"w{i}" for i in range(12)), x]) for x in (one, two)]
    texts += [f"p q r s {x}" for x in (one, two)] + [f"{one}\n{two}\n{one} {two} {one}", one, two]
    texts += [" ".join({"a": "left", "b": "right"}[c] for c in x) for x in (one, two)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    by = lambda out, c: {r["doc_id"]: r[c] for r in out.collect()}
    removed = by(substring_dedup.remove_repeated_windows(df.filter("doc_id < 7")), "n_removed")
    assert not any(removed.values())
    seen = collections.Counter(t.encode()[p : p + 400] for t in texts for p in range(len(t.encode()) - 399))
    got = by(suffix_dedup.remove_repeated_strings(df), "n_removed")
    for d, t in enumerate(texts):
        t, gone = t.encode(), set()
        for p in range(len(t) - 399):
            if seen[t[p : p + 400]] > 1:
                gone |= set(range(p, p + 400))
        assert got[d] == len(gone), d
    rules = quality_rules.judge(df).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rules) == collections.Counter((r[0], *base(r[1])) for r in rows)
    assert by(near_dedup.near_groups(df), "component_id") == near_components([r[:2] for r in rows])
    assert by(near_dedup.near_groups(df), "n_shingles") == {r[0]: len(shingles(r[1])) for r in rows}
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    lm = spark.createDataFrame([(held, two), (held + 1, one), (held + 2, one)], "doc_id long, text string")
    assert zlib.crc32(str(held + 1).encode()) % 5 != 1
    assert by(lm_scoring.score(lm), "n_known")[held] == 1
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    crc = lambda x: zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert by(packing.pack(df, path, size=1 << 16, open_windows=4), "ids_crc32") == {r[0]: crc(r[1]) for r in rows}
