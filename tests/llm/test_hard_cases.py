"""Hot groups, very long texts and odd rows, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.test_llm import frame
from tidemark.llm import queries as q
from tidemark.llm.components import connected_components
from tidemark.llm.decontaminate import find_leaks, simhash, with_shingles
from tidemark.llm.html_text import Line, extract_text, kept_lines, main_text
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.lm_score import lm_scores
from tidemark.llm.nbsvm import Features, dual_coordinate_descent, fit, word_shape
from tidemark.llm.packing import encoder, pack
from tidemark.llm.shared import intermediate_tables, materialize, remove_tables, text_batches
from tidemark.llm.simhash_dedup import near_duplicates
from tidemark.llm.url_filter import judge_urls


def part(k, n):
    return " ".join(f"p{k}w{i}" for i in range(n))


# ---- shared
def test_batches_are_bounded_by_bytes():
    texts = ["a" * 10, None, "b" * 3000, "", "c" * 900, "d" * 200]
    got = list(text_batches(iter([pa.record_batch([pa.array(texts)], ["t"]), pa.record_batch([pa.array([], pa.string())], ["t"])]), 0, rows=3, size=1000))
    assert [b.column(0).to_pylist() for b in got] == [["a" * 10, None], ["b" * 3000], ["", "c" * 900], ["d" * 200], []]


def test_intermediate_tables_go(spark):
    with intermediate_tables() as made:
        df = materialize(spark.range(3), "gone")
    assert df.count() == 3 and len(made) == 1
    remove_tables(spark, made)
    with pytest.raises(Exception):
        spark.read.parquet(made[0]).count()


# ---- 4
def test_lm_counts_summed_in_parts(spark):
    """A word of every document, in far more chunks than a task may meet at once, among rare, repeated and empty texts."""
    docs = [(i, f"the {part(i % 40, 30)} the end" * (1 + i % 3)) for i in range(120)] + [(200, None), (201, ""), (5, "the same"), (5, "the same")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = [sorted((r["doc_id"], r["n_words"], round(r["log_score"], 9)) for r in lm_scores(df, chunk_chars=900, bucket_chars=n, fan_in=f).collect()) for n, f in ((9000, 3), (9000, 10**6), (10**9, 7))]
    assert len(rows[0]) == len(docs) and rows[0] == rows[1] == rows[2]


# ---- 1
def test_hosts_of_any_length(spark):
    host = ".".join("a" for _ in range(20_000)) + ".net"
    pages = spark.createDataFrame([(1, f"http://{host}/fr/x"), (2, f"http://{host}/xx"), (None, f"http://n{'e' * 100_000}t/{'p' * 1_000_000}")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in judge_urls(pages, q.URL_RULES, spark.createDataFrame([(host,), (host,), (None,)], "host string")).collect()}
    assert got == {1: ("net/fr/", "block"), 2: (None, "block"), None: (None, "allow")}


# ---- 3
def test_ratios_by_brute_force_and_dual_optimum(spark):
    rng = random.Random(3)
    texts = {i: " ".join(rng.choice(["good", "fine", "nice"] if i % 2 else ["bad", "poor", "nice"]) if rng.random() < 0.1 else f"w{rng.randrange(40)}" for _ in range(30)) for i in range(200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int")
    weights, bias, a, b = fit(docs, labels)
    known = [i for i in texts if __import__("zlib").crc32(str(i).encode()) % 5]
    counts = np.ones((2, 1 << 18))
    for i in known:
        counts[i % 2][Features().of(texts[i])] += 1
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    again = fit(docs.repartition(7), labels)
    assert np.array_equal(weights, again[0]) and (bias, a, b) == again[1:]  # the same rows are drawn in every run
    rows = [Features().of(texts[i]).astype(np.int64) for i in known]
    y = np.array([1.0 if i % 2 else -1.0 for i in known])
    w, bias = dual_coordinate_descent(rows, y, ratios, rounds=400)
    x = np.zeros((len(rows), 1 << 18 | 1), np.float32)
    for i, r in enumerate(rows):
        x[i, r], x[i, -1] = ratios[r], 1.0
    gram = (x @ x.T) * np.outer(y, y)
    alpha, step = np.zeros(len(rows)), 1 / np.linalg.eigvalsh(gram).max()
    for _ in range(20_000):  # projected gradient on the dual, another way to the same optimum
        alpha = np.clip(alpha + step * (1 - gram @ alpha), 0, 1)
    primal = 0.5 * (w @ w + bias * bias) + sum(max(0.0, 1 - t * (ratios[r] @ w[r] + bias)) for r, t in zip(rows, y))
    dual = alpha.sum() - 0.5 * alpha @ gram @ alpha
    assert 0 < dual and abs(primal - dual) < 0.01 * dual
    support = weights[weights != 0]
    assert len(support) and np.allclose(weights[ratios == 0], 0)


def test_shapes_cover_whole_words():
    assert word_shape("a" * 100 + "9") == "a9" != word_shape("a" * 100) and word_shape("Ab-" * 20) == "Aa-" * 20


# ---- 5
def test_hub_above_its_neighbours_and_equal_fingerprints(spark):
    hub = 10**9
    edges = spark.range(20_000).select(F.lit(hub).cast("long").alias("a"), F.col("id").alias("b"))
    assert connected_components(edges).agg(F.count("*"), F.max("root")).first()[:] == (20_001, 0)
    assert connected_components(edges.limit(0)).count() == 0
    docs = spark.range(1_000_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text")).unionByName(frame(spark, ["one two three", None]).select(F.col("doc_id") + 10**7, "text").toDF("doc_id", "text"))
    got = near_duplicates(docs).groupBy("component_id").count().collect()
    assert sorted(map(tuple, got)) == [(0, 1_000_001), (10**7, 1)]


# ---- 6
def test_line_blocks_by_brute_force():
    """Stretches between surge and dive, found by summing every window anew, on lines without structure."""
    rng = random.Random(6)
    for _ in range(300):
        weights = [rng.choice([0, 0, 0, 5, 30, 90]) for _ in range(rng.randrange(1, 30))]
        lines = [Line("x" if w else "", float(w), 0, i, named=(i, ())) for i, w in enumerate(weights)]
        sums = [sum(weights[i : i + 3]) for i in range(len(weights))]
        runs, i = [], 0
        while i < len(sums):
            j = i
            while j < len(sums) and sums[j]:
                j += 1
            if j > i:
                runs.append((i, j))
            i = max(j, i + 1)
        largest = max(runs, key=lambda r: sum(weights[slice(*r)]), default=None)
        want = [i for r in runs if r == largest or max(sums[slice(*r)]) >= 80 for i in range(*r) if weights[i]]
        assert kept_lines(lines, 3, 80.0) == want


def test_markup_as_html_says():
    long = "Long text here. " * 20
    assert main_text("<p title=it's>one</p><p>two</p><p>don't</p>") == "one\ntwo\ndon't"
    assert main_text('<article><div class="article-header"><h1>Title</h1></div><p class="share-price">5</p><p class=legal>law</p><div class="side note">n</div></article>') == "Title\n5\nlaw\nn"
    assert main_text(f"<div><p><a href=x>A linked sentence.</a></p><p>{long}</p><aside>no</aside><p>End.</p></div><div id=x><a href=y>menu</a></div>") == f"A linked sentence.\n{long.strip()}\nEnd."
    assert main_text(f"<div class=x>{'<p>Short.</p>' * 3}</div><form>no</form><div><p>{long}</p></div>") == long.strip()
    assert main_text(f"<div>{'<p>Short.</p>' * 3}</div><form>no</form><div><p>{long}</p></div>") == "Short.\n" * 3 + long.strip()  # no length is too short
    assert main_text("<p>a <script>x</script>b <button>no</button>c") == "a b c" and main_text("<p>a<p b='c") == "a"
    assert main_text("<div class=sidebar><p>All there is.</p></div>") == "All there is."
    assert main_text("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == "a\nb\nc\nd"
    deep = "<div>" * 50_000 + "x" + "</div>" * 50_000
    assert main_text(deep) == "x" == main_text(deep.replace("<div>", "<div class=x>")) and main_text("<p>y " * 200_000).count("\n") == 199_999


LONG = "A sentence of the article that is long enough. " * 6


@pytest.mark.parametrize(
    "page,text",
    [
        ("<body><form action=x><div><p>{l}</p></div><input name=q><label>Find</label></form></body>", "{l}"),
        ("<article><form><p>{l}</p></form></article>", "{l}"),
        ("<body><p>{l}</p><form><p>Leave a reply</p><button>Send</button></form></body>", "{l}"),
        ("<body><a name=top><p>{l}</p><p>More.</p></body>", "{l}\nMore."),
        ("<body><div><a href=x><p>{l}</p><p>{l}</p></div></body>", "{l}\n{l}"),
        ("<body><p><a href=x>One linked line.</a></p><p><a href=y>Another one.</a></p></body>", "One linked line.\nAnother one."),
        ("<main><h1>Title</h1><article><p>{l}</p></article><p>Closing words.</p></main>", "Title\n{l}\nClosing words."),
        ("<main><article><p>Short first.</p></article><article><p>{l}</p></article></main>", "Short first.\n{l}"),
        ("<body><div><h1>Title</h1><article><p>{l}</p></article><p>Closing words.</p></div><div class=promo>Buy</div></body>", "Title\n{l}\nClosing words."),
        ("<body><div class=box>Buy now.</div><article><p>{l}</p></article><p>Not of it.</p></body>", "{l}"),
        ("<div><p>{l}</p></div><nav>x</nav><div><p>A short closing sentence.</p></div>", "{l}\nA short closing sentence."),
        ("<section><p>{l}</p></section><aside>x</aside><section><p>End.</p></section>", "{l}\nEnd."),
        ("<div class=text><p>{l}</p><aside>x</aside><div><p>End.</p></div></div><nav>x</nav><div class=other><p>Gone.</p></div>", "{l}\nEnd."),
        ('<div class="main-content-sidebar-wrapper"><p>{l}</p></div><nav>x</nav><div class=x><p>Short one.</p></div>', "{l}"),
        ("<main><header><h1>Title</h1></header><p>{l}</p></main><header>Site</header>", "Title\n{l}"),
        ('<p>x <span aria-hidden="true">d</span> y {l}</p>', "x y {l}"),
        ('<p>x <span class="comment">d</span> y {l}</p>', "x d y {l}"),
        ("<article><p>{l}</p></article><section class=comments><article><p>{l} {l}</p></article></section>", "{l}"),
    ],
)
def test_page_shapes(page, text):
    line = LONG.strip()
    assert main_text(page.replace("{l}", line)) == text.replace("{l}", line)


def test_many_open_anchors_and_forms():
    assert main_text("<a href=x>" * 100_000 + "text") == "text"
    assert main_text("<form>" * 20_000 + "<p>text") == "text" and main_text("<p>" + "<a href=x>b</a> " * 100_000 + "</p>").startswith("b b b")


def test_repeated_and_null_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a", "t"), (1, "u", "<p>a", "t"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in extract_text(pages).collect()) == [(0, "", 0), (1, "a", 1), (1, "a", 1)]


# ---- 7
def plain_simhash(hashes):
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_in_all_lanes(spark):
    docs = frame(spark, [part(1, 5), part(2, 40), part(3, 131), part(4, 140), "x y z u v " * 30])
    for r in with_shingles(docs, "text", "doc_id").select("sh", simhash("sh").alias("fp")).collect():
        assert r["fp"] & (1 << 64) - 1 == plain_simhash([h & (1 << 64) - 1 for h in r["sh"]])


def test_recall_of_the_radius(spark):
    """Items with random words replaced: of all pairs that brute force finds at 0.8 or more, the share that is found."""
    rng = random.Random(7)
    items, texts = [], []
    for k in range(600):
        words = part(k, rng.randrange(30, 60)).split()
        items.append(" ".join(words))
        for at in rng.sample(range(len(words)), 1 if len(words) < 50 else rng.choice([1, 2])):
            words[at] = f"other{k}x{at}"
        texts.append(f"{part(10_000 + k, 9)} {' '.join(words)} {part(20_000 + k, 9)}")
    pairs = {}
    for k, (item, text) in enumerate(zip(items, texts)):
        grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        a, b = grams(item.split()), grams(text.split()[9:-9])
        if len(a & b) >= 0.8 * len(a | b):
            pairs[k, k] = round(len(a & b) / len(a | b), 6)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in find_leaks(frame(spark, texts), bench).collect()}
    assert len(pairs) > 150 and set(got) <= set(pairs) and all(got[k] == pairs[k] for k in got)
    recall = len(got) / len(pairs)
    print(f"recall {recall:.4f} of {len(pairs)}, least similarity {min(pairs.values())}")
    assert recall >= 0.98


def test_cut_off_and_repetitive_texts(spark):
    item = part(1, 50)
    words = item.split()
    texts = [" ".join(words[6:]) + " " + part(2, 30), part(3, 30) + " " + " ".join(words[:44]), " ".join(words[3:47]), "la " * 60_000, item + " " + part(4, 250_000)]
    docs = frame(spark, texts).unionByName(frame(spark, [item]).withColumn("doc_id", F.lit(None).cast("long")))
    docs = docs.unionByName(docs.where("doc_id < 3")).unionByName(frame(spark, [part(9, 80)], first=1))
    bench = spark.createDataFrame([(7, item), (8, "la " * 20)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in find_leaks(docs, bench).collect()}
    assert got == {(0, 7): round(40 / 46, 6), (1, 7): round(40 / 46, 6), (2, 7): round(40 / 46, 6), (3, 8): 1.0, (4, 7): 1.0, (None, 7): 1.0}


# ---- 8
def test_added_tokens_and_endless_runs(spark):
    from tokenizers import Tokenizer

    path = q.tokenizer_path("byte_bpe_50k.json")
    library, encode = Tokenizer.from_file(path), encoder(path)
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext", " " * 2_000_000, "^" * 2_000_000, "\n" * 1_000_000 + "end"]
    ids = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids[0] == [64, 220, 50256, 275]
    assert all(encode(t) == np.array(i, "<u4").tobytes() for t, i in zip(texts, ids))
    rows = pack(frame(spark, texts).unionByName(frame(spark, texts[:1])), path).collect()
    assert sum(r["length"] for r in rows) == sum(len(i) + 1 for i in [*ids, ids[0]]) and sum(r["doc_id"] == 0 for r in rows) >= 2


# ---- 9
def lines_left(texts, least=50):
    """All pairs of positions of equal lines, extended both ways."""
    docs = [[(p, x) for p, x in enumerate(t.split("\n")) if x.split()] for t in texts]
    gone = [set() for _ in texts]
    for r, later in enumerate(docs):
        for a, source in enumerate(docs[: r + 1]):
            for shift in range(1 - len(source) if a < r else 1, len(later)):
                run, n = [], 0
                for i in [*range(max(shift, 0), min(len(later), len(source) + shift)), None]:
                    if i is not None and later[i][1] == source[i - shift][1]:
                        run.append(later[i][0])
                        n += len(later[i][1].split())
                        continue
                    if n >= least:
                        gone[r].update(run)
                    run, n = [], 0
    return ["\n".join(x for p, x in enumerate(t.split("\n")) if p not in g) for t, g in zip(texts, gone)]


def test_lines_by_brute_force(spark):
    run = [part(k, 20) for k in range(3)]
    alone = "\n".join(x for k, line in enumerate(run) for x in (part(100 + k, 9), line, part(200 + k, 9)))
    texts = [alone, "\n".join([part(300, 9), *run, part(301, 9)]), "\n".join([part(302, 9), *run, part(303, 9)])]
    got = [r["text"] for r in dedup_lines(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == [alone, texts[1], f"{part(302, 9)}\n{part(303, 9)}"]
    rng = random.Random(9)
    lines = [part(k, rng.choice([1, 3, 10, 20, 30, 49, 50, 60])) for k in range(7)] + ["", " "]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    got = [r["text"] for r in dedup_lines(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == lines_left(texts)


def test_equal_lines_and_long_texts(spark):
    many, one = "\n".join(["the same short line"] * 100_000), part(5, 150_000)
    long = "\n".join(part(k, 40) for k in range(4000))
    got = [r["text"] for r in dedup_lines(frame(spark, [many, one, f"x\n{one}", long, f"{long}\nend"])).orderBy("doc_id").collect()]
    assert got == ["the same short line", one, "x", long, "end"]
    assert xxhash.xxh64_intdigest(one) and len(one) > 1_000_000


# ---- the pipeline
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _row long, th long, doc long, k long, size long"


def test_stages_on_odd_rows(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    extra = (1, 2, 3, 4, 5)
    rows = [(i, part(i, 70), "en", "s", 0, *extra) for i in range(20)]
    odd = rows[:2] + [(None, None, None, None, None, *extra)] * 2 + [(None, part(99, 80), None, None, None, *extra), (30, "", "en", "s", 0, *extra), (31, "w " * 100_000, "en", "s", 0, *extra), (32, part(32, 200_000), "en", "s", 0, *extra)]
    docs = spark.createDataFrame(rows + odd, COLUMNS)
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == cp.COLUMNS, name
        texts = [r["text"] for r in kept.collect()]
        assert part(99, 80) in texts and part(32, 200_000) in texts and {r[1] for r in rows} <= set(texts), name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    assert cp.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0
    assert cp.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().count() == 24


def test_near_copies_in_small_blocks(spark, monkeypatch):
    import tests.llm.test_llm as base
    from tidemark.llm import similar

    monkeypatch.setattr(similar, "BLOCK", 2)
    monkeypatch.setattr(similar, "PIVOTS", 0)
    base.test_near_copies_by_brute_force(spark, {})


def test_lists_are_merged_without_copies_of_them_all():
    """Peak of a merge, beside the numbers that come in: before, every list was held some eight times."""
    import tracemalloc

    from tidemark.llm import lm_score as lm

    rng = np.random.default_rng(3)
    common = rng.integers(0, 1 << 60, 10_000, np.uint64)
    grams = [np.unique(np.concatenate([common, rng.integers(0, 1 << 60, 10_000, np.uint64)])) for _ in range(100)]
    counts = [rng.integers(1, 9, len(g)) for g in grams]
    counts[0][0] = 1 << 40
    lists = lm.pa.table([[0] * 100, list(range(100)), [lm._planes(np.diff(g, prepend=np.uint64(0))) for g in grams], [lm._planes(c) for c in counts]], schema=lm.LISTS)
    tracemalloc.start()
    distinct, sums, places = lm._merged(lists)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    plain, place = np.unique(np.concatenate(grams), return_inverse=True)
    assert np.array_equal(distinct, plain) and np.array_equal(np.concatenate(places), place)
    assert np.array_equal(sums, np.bincount(place, np.concatenate(counts)).astype(np.int64))
    print(f"peak {peak / place.nbytes:.1f} times the n-grams")
    assert peak < 4 * place.nbytes
