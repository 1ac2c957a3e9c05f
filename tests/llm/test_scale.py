"""What lets operators grow: filters, targets, sums, bands, side tables; and the pipeline's stages one after the other."""

import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import exact_dedup, license_scan, mixing, packing, quality_classifier, quality_rules, secret_scan, simhash, warc
from graphloom.llm.common import drop_written, fresh_path, shared_dir, written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("rows", [3000, 100_000])
def test_filters_have_every_repeat(spark, rows):
    """Hashes repeated within a batch, in a part and between parts, in one filter and in many."""
    h = spark.range(rows).selectExpr("id % 3 AS part", f"xxhash64(CASE WHEN id % 4 = 0 THEN id % 20 WHEN id % 4 = 1 THEN id % {rows // 2} ELSE id END) AS h")
    all_ = [(r.part, r.h) for r in h.collect()]
    found = [(r.part, r.h) for r in exact_dedup.maybe_repeated(h.repartition(5, "h", "part"), rows).collect()]
    times = Counter(x for _, x in all_)
    want = {(p, x) for p, x in all_ if times[x] > 1}
    assert want <= set(found) <= set(all_)
    assert len(set(found) - want) < 0.05 * rows
    assert exact_dedup.maybe_repeated(h.limit(0), 0).count() == 0


def slow_targets(sizes, weights, total, most=2):
    """Targets of sources in order, by rounds that cap the sources above `most` times their size."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), total
    while open_:
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / weight > most * sizes[i]}
        for i in over or open_:
            out[i] = float(most * sizes[i]) if over else left * weights[i] / weight
        if not over:
            break
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def test_targets_share_the_excess(spark):
    assert slow_targets([10, 100], [3, 1], 165.0) == [20.0, 145.0]
    rng = random.Random(8)
    for n, share in ((1, 1.5), (2, 3.0), (40, 1.5), (300, 1.5)):
        names = sorted({"".join(rng.choices("aZé漢\U0001f600 ", k=4)) for _ in range(n)})
        sizes = [rng.choice([0, 5, 1000, 10**6]) + rng.randint(0, 50) for _ in [*names, None]]
        rows = [(x, size, 1) for x, size in zip([*names, None], sizes, strict=True)]
        rng.shuffle(rows)
        got = {r.source: (r.k, r.target) for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long, n long").repartition(3), (3, 1, 2), share).collect()}
        want = slow_targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))], share * sum(sizes))
        assert [got[x][0] for x in [*names, None]] == list(range(len(rows)))
        assert np.allclose([got[x][1] for x in [*names, None]], want, rtol=1e-12)


def best_sum(lengths, counts, budget):
    sums = {0}
    for n, c in zip(lengths, counts, strict=True):
        sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= budget}
    return max(sums)


@pytest.mark.parametrize(("longest", "kinds", "window"), [(40, 6, 1 << 14), (40, 6, 8), (30_000, 4, 1 << 14), (30_000, 4, 64), (9, 9, 16)])
def test_fit_reaches_the_best_sum(longest, kinds, window):
    """Any budget, also where lengths are over the window, and where no choice hits the budget."""
    rng = np.random.default_rng(longest + window)
    for _ in range(40):
        lengths = np.unique(rng.integers(1, longest, kinds)) * int(rng.integers(1, 4))
        counts = rng.integers(1, 6, len(lengths))
        budget = int(rng.integers(0, int((lengths * counts).sum()) + 1))
        take = mixing.fit(lengths, counts, budget, window)
        assert (take >= 0).all() and (take <= counts).all()
        assert int((take * lengths).sum()) == best_sum(lengths.tolist(), counts.tolist(), budget)
    for lengths, counts, budget, best in (([15000, 17000], [10, 10], 47000, 47000), ([9000, 11000, 19000], [10, 10, 10], 27000, 27000)):
        assert int((mixing.fit(np.array(lengths), np.array(counts), budget) * lengths).sum()) == best


def test_fit_of_large_budgets():
    """Budgets beyond what dynamic programming fits: reached where short documents are left over."""
    rng = np.random.default_rng(6)
    lengths = np.unique(np.r_[np.arange(20, 400), rng.integers(400, 3_000_000, 300)])
    counts = rng.integers(1, 2000, len(lengths))
    for share in (0.01, 0.5, 0.999):
        budget = int(share * (lengths * counts).sum())
        take = mixing.fit(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and int((take * lengths).sum()) == budget
    assert mixing.fit(np.array([1 << 27]), np.array([5]), 1 << 28).tolist() == [2]


def test_pipeline_mixes_and_packs(spark):
    """run()'s last two stages against what they are to reach, from the third stage's rows."""
    d = "/root/testdata/sf0.001"
    last = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        last = stage(spark, last, d)
    text, source = {}, {}
    for r in last.collect():
        text[r.doc_id], source[r.doc_id] = r.text, r.source
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in text.items()}
    names = sorted(set(source.values()))
    whole = [sum(size[i] for i in text if source[i] == x) for x in names]
    goal = slow_targets(whole, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(whole))
    library = packing.WordIds(packing.tokenizer_path()).tokenizer
    pieces = corpus_pipeline.run(spark, d).collect()
    tokens, words, sequences = Counter(), Counter(), defaultdict(list)
    for p in pieces:
        tokens[p.doc_id] += p.length
        sequences[p.sequence_id].append((p.offset, p.length))
    for i, n in tokens.items():
        each = len(library.encode(text[i], add_special_tokens=False).ids) + 1
        assert n in (each, 2 * each)
        words[source[i]] += size[i] * (n // each)
    for name, all_, target in zip(names, whole, goal, strict=True):
        times = min(2, int(target // all_))
        one = Counter(size[i] for i in text if source[i] == name)
        assert words[name] - times * all_ == best_sum([*one], [*one.values()], round(target - times * all_))
    for x in sequences.values():
        assert [o for o, _ in sorted(x)] == np.cumsum([0, *(n for _, n in sorted(x))])[:-1].tolist() and sum(n for _, n in x) <= 2048


def test_stages_of_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, "")
        assert out.count() == 0 and (name == "packing" or out.columns == empty.columns), name


def test_clashing_names(spark):
    """Extra columns with the names that stages and operators use inside, as other tables' columns."""
    names = ["__rules", "__row", "___row", "__gone", "__times", "__copy", "__id", "__low", "__postings", "row", "part", "gone", "maybe", "sha", "h", "size", "k", "epochs", "name", "of", "kept", "fp", "n"]
    rng = random.Random(2)
    prose = [" ".join(rng.choices("the of and to a river bank carries water slowly past old mills".split(), k=40)) for _ in range(12)]
    rows = [(i, t, "a", *[f"{c}{i}" for c in names]) for i, t in enumerate([*prose, prose[0], None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and set(map(tuple, out.collect())) <= set(rows) and out.count(), name
    assert corpus_pipeline.STAGES[4][1](spark, docs, "").select("doc_id").distinct().count() == len(rows)
    told = secret_scan.scan(docs)
    assert told.columns == [*docs.columns, "__spans"] and {r["__low"][5:] for r in told.collect()} == {str(i) for i in range(len(rows))}
    for f in (exact_dedup.exact_duplicates, simhash.near_duplicates, mixing.mix, lambda x: license_scan.scan(x).select("__license")):
        assert f(docs).count() == len(rows)
    for f in (secret_scan.scan, license_scan.scan, quality_rules.score_documents):
        with pytest.raises(ValueError):
            f(docs.withColumn("__spans", F.lit(1)).withColumn("__license", F.lit(1)))
    pages = spark.createDataFrame([(1, "u", "p", "x"), (2, "v", "p", "y")], "page_id long, url string, html string, first string").withColumn("__row", F.lit(5)).withColumn("sha", F.lit(5))
    path = fresh_path(spark, "clash")
    warc.write_archive(pages, path)
    assert sorted((r.page_id, r.refers_to or 0) for r in warc.payloads(warc.read_archive(spark, path)).collect()) == [(1, 0), (2, 1)]


def test_shared_folder():
    """The session's setting, else the context's folder, else one of our own, but on a local master only."""
    def session(setting, folder, master):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: folder, setCheckpointDir=lambda path: None)
        return SimpleNamespace(conf={"spark.checkpoint.dir": setting}, sparkContext=context)

    assert shared_dir(session("hdfs://a/b/", "file:/c", "spark://host:7077")) == "hdfs://a/b"
    assert shared_dir(session(None, "file:/c", "spark://host:7077")) == "file:/c"
    assert shared_dir(session(None, None, "local[4]")).startswith("file:///")
    with pytest.raises(ValueError):
        shared_dir(session(None, None, "spark://host:7077"))


def test_tables_go_when_they_are_dropped(spark):
    begin = written()
    kept, gone = (fresh_path(spark, x) for x in ("kept", "gone"))
    for path in (kept, gone):
        spark.range(3).write.parquet(path)
    drop_written(begin, kept)
    assert spark.read.parquet(kept).count() == 3 and written() == begin + 1
    with pytest.raises(AnalysisException):
        spark.read.parquet(gone)


@pytest.mark.parametrize(
    ("left", "run"),
    [
        (1, secret_scan.scan), (2, exact_dedup.exact_duplicates), (2, simhash.near_duplicates), (2, mixing.mix), (3, exact_dedup.drop_copies), (4, simhash.keep_one), (4, mixing.repeat_documents),
        (0, lambda docs: warc.write_archive(docs.selectExpr("doc_id AS page_id", "text AS url", "text AS html"), f"{shared_dir(docs.sparkSession)}/archive-{random.random()}")),
    ],
)
def test_what_a_result_needs_is_left(spark, left, run):
    """Tables that the result doesn't read go before it is returned, and the result can be read twice."""
    docs = spark.createDataFrame([(i, f"the old mill by river {i % 5} turns slowly", "ab"[i % 2]) for i in range(20)], "doc_id long, text string, source string")
    begin = written()
    out = run(docs)
    assert written() - begin == left
    if out is not None:
        assert out.count() == out.count() > 0


def test_warc_tells_damage_and_reads_any_path(spark):
    """A payload that isn't what its header claims, in an archive whose path has blanks, per cent signs and a hash mark."""
    path = fresh_path(spark, "a b%20c#d é")
    warc.write_archive(spark.createDataFrame([(1, "http://a/", "good"), (2, "http://b/", "good")], "page_id long, url string, html string"), path)
    bad = warc._member(warc.record(3, "http://c/", b"changed", warc.base32_sha1(b"before"), None))
    with open(f"/{path.removeprefix('file:').lstrip('/')}/more.txt", "wb") as f:
        f.write(bad)
    got = {r.page_id: r for r in warc.payloads(warc.read_archive(spark, path)).collect()}
    assert {i: (r.record_type, r.refers_to, r.damaged) for i, r in got.items()} == {1: ("response", None, False), 2: ("revisit", 1, False), 3: ("response", None, True)}
    assert got[3].payload_digest == warc.base32_sha1(b"changed") and got[3].payload_bytes == 7 and got[2].payload_digest == warc.base32_sha1(b"good")


def slow_alignments(words, templates):
    """(template, place) of every place where the rare tokens that stand right weigh enough, and the key phrase stands."""
    postings, total = license_scan.index(templates)
    out = set()
    for t, template in enumerate(templates):
        notice, key = template.notice.split(), template.key.split()
        rare = [(p, w, x) for p, w in enumerate(notice) for tt, pp, x in postings.get(w, []) if (tt, pp) == (t, p)]
        inside = next(i for i in range(len(notice)) if notice[i : i + len(key)] == key)
        for at in range(-len(notice), len(words)):
            cover = sum(x for p, w, x in rare if 0 <= at + p < len(words) and words[at + p] == w)
            if at + inside >= 0 and words[at + inside : at + inside + len(key)] == key and cover >= license_scan.COVER * total[t] - 1e-9:
                out.add((t, at))
    return out


def test_license_alignments(spark):
    """Whole notices, notices that are cut, lack words or have others between, and their words shuffled, against every place."""
    rng, every = random.Random(12), (*license_scan.BASE, *license_scan.TEMPLATES)
    texts = []
    for t in every:
        words = t.notice.split()
        texts += [t.notice.upper(), f"x {t.notice}, {t.notice}", t.key, " ".join(words[: len(words) * 2 // 3]), " ".join(words[len(words) // 3 :]), " ".join(rng.sample(words, len(words)))]
        texts += [" ".join(w if rng.random() > 0.2 else rng.choice(["the", "", "mit mit"]) for w in words) for _ in range(3)]
    texts += ["// SPDX-License-Identifier: MIT", "# SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: none"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    told = {r.doc_id: r["__license"] for r in license_scan.scan(df).collect()}
    for i, t in enumerate(texts):
        assert {(x.t, x.at) for x in told[i].found} == slow_alignments(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()), every), t
    assert [told[len(texts) - k].labels for k in (3, 2, 1)] == [["mit"], ["gpl-3.0"], []]
    assert all(t.label in told[9 * k].labels for k, t in enumerate(every))


def slow_score(net, raw):
    """The network's definition, byte by byte."""
    p, q = net.p, quality_classifier
    b = list(raw)
    b += [q.PAD] * (q.FILL - len(b)) if len(b) < q.FILL else (b * 2)[: -len(b) % q.STRIDE]
    n = len(b)
    b += [q.PAD] * q.STRIDE
    kernel = p["filter"].reshape(q.KERNEL, q.WIDTH, q.FILTERS)
    at = np.array([np.maximum(0, sum(p["embed"][b[i + k]] @ kernel[k] for k in range(q.KERNEL)) + p["bias"]) for i in range(n)])
    chunks = [at[k : k + q.CHUNK].mean(0) for k in range(0, n - q.CHUNK + 1, q.STRIDE)]
    return 1 / (1 + np.exp(-(np.max(chunks, 0) @ p["out"] + p["shift"][0])))


def test_classifier_scores_by_its_definition():
    rng = np.random.default_rng(7)
    net = quality_classifier.Network()
    raws = [b"", b"a", rng.bytes(255), rng.bytes(256), rng.bytes(257), rng.bytes(1000), b"word " * 700, rng.bytes(9000)]
    net.train(raws[2:6], np.array([0, 1, 0, 1]), steps=3)
    assert np.allclose(net.scores(raws), [slow_score(net, x) for x in raws], atol=1e-4)


def test_classifier_learns_from_whole_texts():
    """Junk that stands once, anywhere in texts of over 8 KB, is learned and found."""
    rng = np.random.default_rng(5)
    words = "the quick river carries small boats under an old bridge where people gather before evening comes".split()
    prose = [" ".join(rng.choice(words, 2500)) for _ in range(60)]
    bad = [t[:k] + " zxq#9$ zqx#7$" * 12 + t[k:] for t, k in zip(prose, rng.integers(0, 12000, 60), strict=True)]
    net = quality_classifier.Network()
    net.train([x.encode() for x in prose[:40] + bad[:40]], np.repeat([1, 0], 40), steps=40)
    assert np.mean(np.r_[net.scores([x.encode() for x in prose[40:]]) >= 0.5, net.scores([x.encode() for x in bad[40:]]) < 0.5]) > 0.9


def test_many_bands_connect_what_a_sweep_connects(monkeypatch):
    """With parts so small that up to four bands have to agree."""
    rng = np.random.default_rng(9)
    fp = rng.integers(0, 1 << 63, 300).astype(np.uint64) & ~np.uint64((1 << 22) - 1)
    bit = lambda: np.uint64(1) << rng.integers(22, 64, 300).astype(np.uint64)
    fp = np.unique(np.r_[fp, *[fp ^ bit() ^ bit() for _ in range(3)]])
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    want = {frozenset(x) for x in zip(i.tolist(), j.tolist(), strict=True) if x[0] != x[1]}
    for part in (64, 1, 1 / 64, 1 / 4096):
        monkeypatch.setattr(simhash, "_PART", part)
        x, y = simhash.sweep_bands(fp, 0, 4)
        root = list(range(len(fp)))

        def find(k, root=root):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            assert frozenset((a, b)) in want
            root[find(a)] = find(b)
        assert all(find(a) == find(b) for a, b in map(tuple, want))
