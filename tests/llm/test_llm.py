"""Each operator against a brute-force version, and its edge cases."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import queries as q
from tidemark.llm.components import connected_components
from tidemark.llm.decontaminate import decontaminate, find_leaks
from tidemark.llm.html_text import extract_text, main_text
from tidemark.llm.line_dedup import dedup_lines, dedup_words
from tidemark.llm.lm_score import lm_scores
from tidemark.llm.nbsvm import quality_scores
from tidemark.llm.packing import encoder, pack, subset_counts
from tidemark.llm.quality_rules import measure_text, quality_rules
from tidemark.llm.shared import join_groups, salted, salts_seen
from tidemark.llm.simhash_dedup import bucket_edges, covering_masks, near_duplicates, near_edges, simhash
from tidemark.llm.token_counts import SharedForward, Vocabulary, count_one, token_counts
from tidemark.llm.url_filter import build_cascade, judge_urls

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, h string, words string, label int"


def frame(spark, texts, first=0):
    """Documents with columns whose names the operators use inside."""
    rows = [(i + first if i >= 0 else None, t, "en", "s", 0, "x", "y", "z", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


EDGE = [None, "", "   \n ", "one", "one", "w " * 5000, "a\u0301 ü 汉字 \U0001f600 <|endoftext|>"]


@pytest.mark.parametrize("run", [
    lambda d: quality_rules(d), lambda d: lm_scores(d), lambda d: near_duplicates(d), lambda d: dedup_lines(d),
    lambda d: token_counts(d, q.tokenizer_path("piece_bpe_32k.model")),
], ids=["rules", "lm", "simhash", "lines", "tokens"])
def test_edges_and_empty_tables(spark, run):
    docs = frame(spark, EDGE).unionByName(frame(spark, EDGE[:1]).withColumn("doc_id", F.lit(None).cast("long")).withColumn("source", F.lit(None).cast("string")))
    assert run(docs).count() == len(EDGE) + 1
    assert run(docs.limit(0)).count() == 0
    assert run(docs.unionByName(docs)).count() == 2 * len(EDGE) + 2


# ---- 1
def host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, after = rest[:cut], rest[cut:]
    cut = min((after.find(c) for c in "?#" if c in after), default=len(after))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), after[:cut]


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.com/en/x?q=1", "http://www.example.com/en/", "http://example.com", "https://x.net/fr/1#a", "https://x.net/de/", "http://notexample.com/en/", "ftp://com/", "http://net/es/", "http://b.org/?x", "http://b.org/?x", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "k", "r") for i, u in enumerate(urls)], "page_id long, url string, key string, rule string")
    listed = spark.createDataFrame([("b.org",), ("unseen.org",)], "host string")
    got = {r["page_id"]: tuple(r)[1:] for r in judge_urls(pages, q.URL_RULES, listed).collect()}
    for i, u in enumerate(urls):
        host, path = host_path(u)
        fit = [(len(r), r, a) for a, r in q.URL_RULES for h, p in [(r[: r.index("/")], r[r.index("/"):])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fit)[1] if fit else None
        verdict = max(fit)[2] if fit else "block" if host == "b.org" else "allow"
        assert got[i] == (host, path, rule, verdict), u
    assert judge_urls(pages.limit(0), q.URL_RULES, listed).count() == 0


def test_cascade_is_exact_in_parts_too(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed = universe.where("key like '%7'")
    cascade = build_cascade(listed, universe, rate=0.25)
    assert len(cascade.levels) > 2 and all((f"k{i}" in cascade) == (i % 10 == 7) for i in range(3000))
    pages = universe.select(F.lit(1).alias("page_id"), F.concat(F.lit("http://"), "key", F.lit("/")).alias("url"))
    parts = judge_urls(pages, q.URL_RULES, listed.withColumnRenamed("key", "host"), max_bytes=100)  # three cascades
    assert sorted(r["host"] for r in parts.where("verdict = 'block'").collect()) == sorted(f"k{i}" for i in range(7, 3000, 10)) and parts.count() == 3000


# ---- 2
def test_measures():
    assert measure_text("a b c a b c d\n\n x \nx\n x ") == (10, 10, 0, 1, 4, 6)
    assert measure_text("# a|b\u3000c") == (2, 6, 2, 0, 1, 0)


def test_bad_hosts_are_rejected(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, good, "en", f"ok{i % 9}", 0) for i in range(90)] + [(100 + i, "junk" if i < 29 else good, "en", "bad", 0) for i in range(30)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert all(got[i] for i in range(90)) and not got[129]


def kept_by_rules(rows):
    """Positions of the rows (host, text) that the rules and the verdicts of their hosts leave, one host after the other."""
    base, symbols, failed = [], [], defaultdict(list)
    for host, text in rows:
        words, chars, signs, doubled, lines, repeated = measure_text(text)
        base.append(words < 50 or 100 * repeated > 50 * words)
        symbols.append(signs * 100 > chars * 10)
        failed[host].append(base[-1] or symbols[-1] or doubled * 100 > lines * 30)
    rates = [sum(f) / len(f) for f in failed.values()]
    m = sum(rates) / len(rates)
    v = sum((r - m) ** 2 for r in rates) / len(rates)
    k = min(max(m * (1 - m) / v - 1, 1.0), 1e6) if v else 1e6
    shrunk = {h: (sum(f) + m * k) / (len(f) + k) for h, f in failed.items()}
    strict = {h for h, r in shrunk.items() if r > m + (m * (1 - m) / (k + 1)) ** 0.5 / 2}
    return {i for i, (host, _) in enumerate(rows) if not base[i] and shrunk[host] <= 0.6 and not (host in strict and symbols[i])}


def test_hosts_that_stand_out_are_strict(spark):
    good = " ".join(f"w{i}" for i in range(80))
    signs = " ".join(f"w{i} $#%" for i in range(80))
    lines = "\n".join([good] + ["a b"] * 30)
    rows = [(f"ok{i % 9}", good) for i in range(90)] + [("ok1", signs), ("ok2", lines)]
    rows += [("odd", signs)] * 5 + [("odd", lines)] + [("odd", good)] * 10 + [("bad", "junk")] * 40 + [("bad", good), (None, good), (None, signs), (None, None), ("", ""), ("", good)]
    docs = spark.createDataFrame([(i, t, "en", h, 0) for i, (h, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in quality_rules(docs).collect()}
    assert {i for i, r in got.items() if r["kept"]} == kept_by_rules(rows) and len(got) == len(rows)
    assert got[90]["kept"] and not got[92]["kept"] and got[92]["host_strict"] and not got[92]["host_rejected"]
    assert got[97]["kept"] and got[98]["kept"] and got[148]["host_rejected"] and not got[148]["kept"]
    alike = quality_rules(docs.withColumn("source", F.lit("one"))).collect()
    assert not any(r["host_strict"] or r["host_rejected"] for r in alike)


# ---- 3
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_scores(docs, labels)
    known = scored.join(labels, "doc_id").where("held_out").select("predicted", "quality", "score").collect()
    assert scored.count() == docs.count() and np.mean([r["predicted"] == r["quality"] for r in known]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in known)
    none = quality_scores(frame(spark, EDGE), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and len(none) == len(EDGE)


# ---- 4
def test_lm_scores_by_hand(spark, texts):
    some = dict(list(texts.items())[:40])
    words = {i: (t or "").encode().split() for i, t in some.items()}
    uni, bi = Counter(w for d in words.values() for w in d), Counter(p for d in words.values() for p in zip(d, d[1:]))
    n = sum(uni.values())
    got = {r["doc_id"]: r["log_score"] for r in lm_scores(frame(spark, []).unionByName(spark.createDataFrame([(i, t, "", "", 0, "", "", "", 0) for i, t in some.items()], DOCS)), chunk_chars=20_000, bucket_chars=30_000).collect()}
    for i, d in words.items():
        u, b, total = Counter(d), Counter(zip(d, d[1:])), 0.0
        for k, w in enumerate(d):
            back = (uni[w] - u[w] + 1) / (n - len(d) + 1)
            seen = k and bi[d[k - 1], w] - b[d[k - 1], w]
            total += math.log(seen / (uni[d[k - 1]] - u[d[k - 1]]) if seen else back * (0.4 if k else 1))
        assert abs(got[i] - total / max(len(d), 1)) < 1e-9


# ---- 5
def brute_groups(prints):
    ids, root = list(prints), {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (prints[ids[a]] ^ prints[ids[b]]).bit_count() <= 3:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark, documents, texts):
    prints = {i: plain_simhash(t) for i, t in texts.items()}
    assert all(simhash(t) == prints[i] for i, t in texts.items())
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in q.op5_simhash_dedup(spark, SF).collect()}
    groups = brute_groups(prints)
    assert got == {i: (f"{prints[i]:016x}", groups[i]) for i in texts}


def test_covering_masks_meet_every_pair():
    masks, rng = covering_masks(3), np.random.default_rng(0)
    assert len(masks) == 15
    for _ in range(3000):
        flip = sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False))
        assert any(not flip & m for m in masks)


def test_split_buckets_lose_no_link(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 1 << 62))
    values = {base} | {base ^ sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(300)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    whole = connected_components(near_edges(prints)).select("root").distinct().count()
    split = connected_components(near_edges(prints, block=16)).groupBy("root").count().collect()
    assert whole == len(split) == 1 and split[0]["count"] == len(values)
    assert len(bucket_edges(np.array(signed), 3)) == len(values) - 1


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 400)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(101)}, 400: 400, 500: 400}


# ---- 6
PAGE = """<!DOCTYPE html><HTML><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><main><article><h1>Title &amp; more</h1><p>First   <b>bold</b>
text.</p><p>x &lt; y&nbsp;z</p><script>var t="</p>";</script><div class="ad">Buy now, this is long and loud advertising text that should not be kept at all.</div><p>End.</p></article>
<section id="comments"><p>Great post, I liked it a lot and wrote a long comment about everything that came to mind.</p></section></main>
<aside>Side words</aside><form><input value="x">Search the site</form><footer>&copy; all</footer></body></html>"""


def test_article_alone():
    assert main_text(PAGE) == "Title & more\nFirst bold text.\nx < y z\nEnd."
    plain = "<div id=menu><a href=a>One</a><a href=b>Two</a></div><div><p>" + "Long text here. " * 20 + "</p><p>More.</p></div>"
    assert main_text(plain).endswith("Long text here.\nMore.")
    assert main_text(None) == main_text("") == main_text("<p>") == "" and main_text("<p>a<br>b &bogus; &am") == "a b &bogus; &am"


def test_article_text_is_not_swallowed():
    for name in ("content no-sidebar", "has-sidebar", "social-history"):
        assert main_text(f'<div class="{name}"><p>One two three.</p><p>Four.</p></div>') == "One two three.\nFour.", name
    for name in ("site-footer", "sidebar", "x comments", "cookie-notice", "main-nav"):
        assert main_text(f'<div><p>One two three.</p></div><div class="{name}"><p>Gone.</p></div>') == "One two three.", name
    assert main_text('<div><p class=ad>Buy now<p>One two.<p>Three.</div>') == "One two.\nThree."
    assert main_text('<div><div><p class=ad>Buy <b>now</div>One two.</div>') == "One two."
    assert main_text('<ul><li class=ad>Buy<ul><li>x</li></ul>more<li>One two.</ul><p>Three.') == "One two.\nThree."


def test_extraction(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (3, "u", "", "t")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract_text(pages).collect()}
    assert got[1][1] == len(main_text(PAGE)) and got[2] == got[3] == ("", 0) and extract_text(pages.limit(0)).count() == 0


# ---- 7
def test_leaks(spark):
    item = " ".join(f"word{i}" for i in range(40))
    docs = frame(spark, [f"before that {item.upper()} and after", " ".join(item.split()[:20]), item.replace("word30", "other"), f"x {item} y {item}", None, "", item.replace(" ", ", ")])
    bench = spark.createDataFrame([(7, item, 1), (8, "too short", 1), (9, None, 1), (7, item, 1)], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]): (r["position"], r["similarity"]) for r in find_leaks(docs, bench).collect()}
    assert got[(0, 7)] == (2, 1.0) and got[(3, 7)] == (1, 1.0) and got[(6, 7)] == (0, 1.0) and set(d for d, _ in got) == {0, 3, 6}
    assert sorted(r["doc_id"] for r in decontaminate(docs, bench).collect()) == [1, 2, 4, 5]
    assert find_leaks(docs.limit(0), bench).count() == 0 and find_leaks(docs, bench.limit(0)).count() == 0


def test_no_window_at_the_threshold_is_missed(spark):
    items = [[f"i{k}w{i}" for i in range(50)] for k in range(500)]
    docs = frame(spark, ["so " + " ".join([*w[:25], "other", *w[26:]]) + " it is" for w in items])  # 41 of 51 shingles
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(None, "la la la la la la ha")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["position"], r["similarity"]) for r in find_leaks(docs, bench).collect()}
    assert got == {(k, k, 1, round(41 / 51, 6)) for k in range(500)}
    songs = {r["doc_id"]: (r["item_id"], r["similarity"]) for r in find_leaks(frame(spark, ["x la la la la la la ha", "la la la la la ha"]), bench).collect()}
    assert songs[0] == (None, 1.0)


# ---- 8
@pytest.mark.parametrize("lengths,capacity,best", [([(7, 2), (5, 3)], 19, 19), ([(9, 1), (4, 2)], 10, 9), ([], 5, 0), ([(3, 10)], 20, 18)])
def test_subset_sum(lengths, capacity, best):
    picked = subset_counts(lengths, capacity)
    assert sum(n * c for n, c in picked.items()) == best and all(c <= dict(lengths)[n] for n, c in picked.items())


def check_packing(rows, ids):
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], r["length"]))
    for parts, whole in [*((p, len(ids[d])) for d, p in pieces.items()), *((s, None) for s in sequences.values())]:
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == whole if whole is not None else at <= 1024 and at & (at - 1) == 0
    assert set(pieces) == set(ids)


def test_packing(spark, documents, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(q.tokenizer_path("byte_bpe_50k.json"))
    encode = encoder(q.tokenizer_path("byte_bpe_50k.json"))
    odd = ["a  b", "\n a", "it's  don't 12 3", "a\u0085 b \t c", *[t or "" for t in EDGE]]
    for t in [*odd, *list(texts.values())[:30]]:
        assert encode(t or "") == np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in texts.items()}
    check_packing(q.op8_packing(spark, SF).collect(), ids)
    edge = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(EDGE)}
    check_packing(pack(frame(spark, EDGE), q.tokenizer_path("byte_bpe_50k.json")).collect(), edge)
    assert pack(frame(spark, []), q.tokenizer_path("byte_bpe_50k.json")).count() == 0


# ---- 9
def test_repeated_runs(spark):
    line = lambda k, n=20: " ".join(f"l{k}w{i}" for i in range(n))
    run = [line(k) for k in range(4)]
    long = line(99, 60)
    docs = frame(spark, [
        "\n".join([line(50), *run, line(51)]),
        "\n".join([line(52), run[0], run[1], "", run[2], run[3], line(53)]),
        "\n".join([run[0], line(54), run[1]]),  # too few words in a row
        f"{line(55)}\n{long}", f"{long}\n{line(56)}\n{long}", None, "",
    ])
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs).collect()}
    assert got[0].count("\n") == 5 and got[1] == f"{line(52)}\n\n{line(53)}" and got[2].count("\n") == 2
    assert got[3].endswith(long) and got[4] == line(56) and got[5] is None and got[6] == ""


def test_copies_and_repeated_rows(spark):
    text = "\n".join(" ".join(f"a{k}b{i}" for i in range(30)) for k in range(5))
    docs = frame(spark, [text, text])
    assert [r["n_removed"] for r in dedup_lines(docs).orderBy("doc_id").collect()] == [0, 5]
    assert [r["n_removed"] for r in dedup_lines(docs.unionByName(docs)).orderBy("doc_id").collect()] == [0, 0, 5, 5]
    assert dedup_lines(docs).columns[: len(docs.columns)] == docs.columns


def without_repeats(texts):
    """The words of each text that lie in no window of 50 words that occurs earlier."""
    seen, out = {}, []
    for r, t in enumerate(texts):
        words = (t or "").split()
        gone = set()
        for i in range(len(words) - 49):
            if seen.setdefault(tuple(words[i : i + 50]), (r, i)) != (r, i):
                gone.update(range(i, i + 50))
        out.append([w for i, w in enumerate(words) if i not in gone])
    return out


def test_every_repeated_window_of_words_goes(spark, texts):
    part = lambda k, n: " ".join(f"p{k}w{i}" for i in range(n))
    common = [part(k, 10) for k in range(6)]
    # each common line is first seen among others, so that no first position of a line helps
    some = ["\n".join([part(100 + k, 30), line, part(200 + k, 30)]) for k, line in enumerate(common)]
    some += ["\n".join([part(301, 9), *common, part(302, 9)]), "\n".join([part(303, 9), *common, part(304, 9)])]
    some += [f"{part(401, 7)} {part(400, 50)} {part(402, 7)}", f"{part(403, 7)} {part(400, 20)} x {part(400, 50)}\n{part(404, 7)}\n"]  # inside lines
    some += ["w " * 300, "a b c " * 18, part(500, 49), part(500, 49), part(501, 80), part(501, 80), None, "", *[texts[i] for i in sorted(texts)]]
    got = [r["text"] for r in dedup_words(frame(spark, some)).orderBy("doc_id").collect()]
    assert [(t or "").split() for t in got] == without_repeats(some)
    assert got[7] == f"{part(303, 9)}\n{part(304, 9)}" and got[9] == f"{part(403, 7)} {part(400, 20)} x\n{part(404, 7)}\n" and got[-len(texts) - 2 : -len(texts)] == [None, ""]
    assert dedup_words(frame(spark, some).limit(0)).count() == 0


# ---- 10
def test_token_counts(spark, documents, texts):
    model = Vocabulary(q.tokenizer_path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r["n_tokens"] for r in q.op10_token_counts(spark, SF).collect()}
    assert all(got[i] == count_one(t, model) for i, t in texts.items())
    word, best = "▁thering", {0: (0.0, 0)}
    for end in range(1, len(word) + 1):  # all segmentations, no sharing
        best[end] = min(((best[a][0] + model.cost[word[a:end]], best[a][1] + 1) for a in range(end) if word[a:end] in model.cost), default=(best[end - 1][0] + model.byte_cost, best[end - 1][1] + 1))
    assert SharedForward(model).tokens(word) == best[len(word)][1]


# ---- the pipeline
def test_pipeline(spark, texts):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == cp.COLUMNS
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = [(r["doc_id"], r["source"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert set(kept["quality_rules"]) == {rows[i][0] for i in kept_by_rules([r[1:] for r in rows])}
    groups = brute_groups({i: plain_simhash(t) for i, t in kept["line_dedup"].items()})
    assert set(kept["simhash_near_dedup"]) == {i for i, c in groups.items() if i == c}
    leaks = {r["doc_id"] for r in find_leaks(docs, bench).collect()}
    assert not leaks and set(kept["decontamination"]) <= set(kept["simhash_near_dedup"])
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(q.tokenizer_path("byte_bpe_50k.json"))
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in kept["decontamination"].items()}
    check_packing(cp.run(spark, SF).collect(), ids)


def test_no_passage_of_fifty_words_is_left_twice(spark, documents, texts):
    import corpus_pipeline as cp

    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cp.cut_repeated_lines(spark, documents, SF).collect()}
    ids = sorted(texts)
    assert [(got[i][0] or "").split() for i in ids] == without_repeats([texts[i] for i in ids])
    assert all(n == len(t) for t, n in got.values() if t is not None)


def test_texts_are_told_apart_in_both_ways(spark, monkeypatch):
    from tidemark.llm import shared

    part = lambda k, n: " ".join(f"v{k}w{i}" for i in range(n))
    some = [f"{part(0, 60)} {part(1, 9)}", f"{part(2, 9)}\n{part(0, 60)}", part(3, 70), part(3, 70), None, None, "", " ", part(4, 8)]
    docs = frame(spark, some)
    docs = docs.unionByName(docs.where("doc_id < 5"))
    few = [tuple(r) for r in dedup_words(docs).collect()]
    monkeypatch.setattr(shared, "MAX_BROADCAST_ROWS", 0)
    many = [tuple(r) for r in dedup_words(docs).collect()]
    order = lambda rows: sorted(rows, key=repr)
    assert order(few) == order(many) and len(few) == docs.count()
    assert dedup_words(docs).columns == docs.columns


def test_near_copies_by_brute_force(spark, texts):
    from tidemark.llm.similar import similar_groups

    rng = np.random.default_rng(5)
    some = [t for t in texts.values()]
    for k in range(12):
        base = [f"b{k}w{i}" for i in range(60 + 30 * k)]
        for rate in (0.005, 0.01, 0.015, 0.02, 0.03):
            some.append(" ".join(f"x{rng.integers(1 << 40)}" if rng.random() < rate else w for w in base))
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for t in some for w in [(t or "").encode().lower().split()]]
    root = list(range(len(some)))
    for a in range(len(some)):
        for b in range(a):
            both, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if both >= 0.8 * union and root[a] != root[b]:
                root = [root[b] if r == root[a] else r for r in root]
    got = {r["row"]: r["group"] for r in similar_groups(frame(spark, some), "doc_id").collect()}
    groups = lambda of: {frozenset(i for i in range(len(some)) if of[i] == g) for g in set(of)}
    assert groups([got[i] for i in range(len(some))]) == groups(root) and len(set(root)) < len(some) - 20
    prints = brute_groups({i: plain_simhash(t) for i, t in enumerate(some)})
    assert any(root[a] == root[b] and prints[a] != prints[b] for a in range(len(some)) for b in range(a))  # 3 bits miss them
    assert similar_groups(frame(spark, some).limit(0), "doc_id").count() == 0


def test_near_copies_are_found_by_fingerprints(spark, monkeypatch):
    from tidemark.llm import similar

    bases = [[f"s{k}w{i}" for i in range(20 + 9 * k)] for k in range(30)]
    some = [" ".join(w) for w in bases] + [" ".join(w[:-1] + ["else"]) for w in bases] + ["a b c d e f g h", "a b c d e f g h i"]
    prints = [similar.fingerprint(similar.shingle_set(t)) for t in some]
    for t, p in zip(some, prints):  # the first word is the plain majority of mixed hashes
        h = similar.shingle_set(t) * similar.FACTORS[0]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        assert int(p[0]) == sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))
    bits = np.array(prints)
    near = np.bitwise_count(bits[:, None] ^ bits[None]).sum(2, dtype=int) <= similar.RADIUS
    links = similar.cell_links(bits, similar.RADIUS)
    assert all(near[a, b] for a, b in links) and brute_roots(len(bits), links) == brute_roots(len(bits), list(zip(*np.nonzero(near))))
    groups = lambda: len({r["group"] for r in similar.similar_groups(frame(spark, some), "doc_id").collect()})
    assert groups() == len(some) - 31
    monkeypatch.setattr(similar, "CELL", 7)
    assert groups() == len(some) - 31
    monkeypatch.setattr(similar, "RADIUS", 0)  # no other way leads to a link
    assert groups() == len(some)


def brute_roots(n, links):
    root = list(range(n))
    for a, b in links:
        x, y = sorted((root[a], root[b]))
        root = [x if r == y else r for r in root]
    return root


def test_verdicts_belong_to_rows(spark):
    import corpus_pipeline as cp

    text = lambda k, n=70: " ".join(f"t{k}w{i}" for i in range(n))
    rows = [(1, text(1)), (1, text(1)), (2, text(2)), (2, "junk"), (None, text(3)), (None, "junk"), (None, text(1)), (5, text(5)), (5, "too short"), (6, text(6)), (6, text(6))]
    rows += [(100 + k, text(100 + k)) for k in range(20)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    good = cp.drop_low_quality(spark, docs, SF)
    assert sorted(r["text"] for r in good.collect()) == sorted(t for _, t in rows if len(t) > 20)
    one = cp.keep_one_of_each_group(spark, good, SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in one if (r["doc_id"] or 0) < 100) == [(0, text(3)), (1, text(1)), (2, text(2)), (5, text(5)), (6, text(6))] and len(one) == 25
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("size(split(text, ' ')) > 20").first()["text"]
    leaks = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in [(7, item), (7, text(7)), (None, item), (None, text(8)), (None, None)]], docs.schema)
    assert sorted(r["text"] or "" for r in cp.drop_leaks(spark, leaks, SF).collect()) == ["", text(7), text(8)]
    assert cp.keep_one_of_each_group(spark, docs.limit(0), SF).count() == 0


def test_salted_groups_keep_every_row(spark):
    keys = ["hot"] * 1000 + [None, None, "rare"]
    rows = salted(spark.createDataFrame(list(enumerate(keys)), "id long, key string"), "id")
    joined = join_groups(rows, rows.groupBy("key").agg(F.count("*").alias("n"), salts_seen()), "key")
    assert joined.columns == ["id", "key", "n"]
    assert sorted(map(tuple, joined.collect())) == [(i, k, keys.count(k)) for i, k in enumerate(keys)]
    spread = rows.where("key = 'hot'").select("_salt").distinct().count()
    assert spread == 64
    assert join_groups(rows.limit(0), rows.limit(0).groupBy("key").agg(salts_seen()), "key").count() == 0
