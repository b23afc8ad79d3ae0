"""Learned operators on rows they did not learn from, and against plain versions; the pipeline against plain stages."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from xylem.llm import jaccard, language, pieces, quality, toxicity
from xylem.llm import textops as t

SYLLABLES = {"en": ["the", "ing", "er", "and", "wh"], "de": ["sch", "ung", "ein", "ü", "cht"], "es": ["ción", "ar", "os", "ñ", "qu"]}


def fold(i):
    return zlib.crc32(str(i).encode()) % 4


def word(r, parts, n=3):
    return "".join(r.choice(parts) for _ in range(n))


def test_language_held_out_and_plain(spark):
    r = random.Random(21)
    rows = [(i, " ".join(word(r, SYLLABLES[x]) for _ in range(r.randrange(3, 30))), x) for i in range(600) for x in [r.choice(list(SYLLABLES))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    names, space = language.prototypes(df)
    out = {x.doc_id: x for x in language.identified(df, (names, space)).collect()}
    held = [x for x in rows if fold(x[0]) == 2]
    assert len(held) > 100 and np.mean([out[i].lang_pred == lang for i, _, lang in held]) > 0.98

    # by definition: bind rotated letter vectors, bundle triples, bundle unit documents of the training folds
    base, letter = language._base().astype(float), language._letters()

    def vector(text):
        code = [0]
        for c in text:
            k = int(letter[ord(c)])
            if k or code[-1]:
                code.append(k)
        code += [0] if code[-1] else []
        v = np.zeros(language.DIM)
        for a, b, c in zip(code, code[1:], code[2:]):
            v += np.roll(base[a], 2) * np.roll(base[b], 1) * base[c]
        return v / max(np.linalg.norm(v), 1e-9)

    sums = {x: sum(vector(s) for i, s, lang in rows if lang == x and fold(i) != 2) for x in names}
    protos = {x: v / np.linalg.norm(v) for x, v in sums.items()}
    for i, s, _ in held[:60]:
        cos = {x: float(vector(s) @ p) for x, p in protos.items()}
        assert out[i].lang_pred == max(cos, key=cos.get) and abs(out[i].score - max(cos.values())) < 1e-3


def test_toxicity_held_out(spark):
    r = random.Random(22)
    plain, rude = [word(r, ["lo", "ra", "mi", "ne", "tu"], 4) for _ in range(300)], ["scumble", "wretchy", "vermiss"]
    rows = []
    for i in range(3000):
        toxic = i % 6 == 0
        words = [r.choice(plain) for _ in range(25)] + ([r.choice(rude) for _ in range(2)] if toxic else [])
        r.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    df = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").repartition(3)
    # most toxic rows have no label, and are among the unlabelled ones
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if r.random() < 0.35], "doc_id long, toxic int")
    out = {x.doc_id: x.score for x in toxicity.scored(df, toxicity.train(df, labels)).collect()}
    held = [x for x in rows if fold(x[0]) == 2]
    hit = [(out[i] >= toxicity.THRESHOLD, y) for i, _, y in held]
    assert sum(a for a, y in hit if y) > 0.95 * sum(y for _, y in hit) and sum(a for a, y in hit if not y) < 0.02 * len(hit)


def test_toxicity_repeated_and_null_rows(spark):
    rows = [(i % 40, f"a{i % 7} b{i % 5}") for i in range(200)] + [(None, "a1"), (7, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Score", F.lit(9))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2, "doc_id long, toxic int")
    out = toxicity.scored(df, toxicity.train(df, labels)).collect()
    assert len(out) == len(rows) and all(0 <= x.score <= 1 for x in out)


def quality_rows(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        good = r.random() < 0.75
        words = [word(r, ["ta", "ro", "mi", "sel", "ka", "ven"], 2) for _ in range(r.randrange(40, 90))]
        if not good:
            words = [w.upper() + r.choice(["%%", "##", "", "!!"]) for w in words] if r.random() < 0.5 else [words[0]] * len(words)
        out.append((i, " ".join(words) + ("." if good else ""), int(good)))
    return out


def test_quality_held_out(spark):
    rows = quality_rows(23, 900)
    df = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").repartition(3)
    model = quality.learn(df.where("doc_id < 500"))
    out = {x.doc_id: x.keep for x in quality.judged(df, model).collect()}
    assert np.mean([out[i] == bool(y) for i, _, y in rows if i >= 500]) > 0.97
    # null and repeated ids learn and are judged like others
    odd = df.unionByName(spark.createDataFrame([(None, x) for _, x, _ in rows[:300]] + [(1, rows[1][1])] * 3, "doc_id long, text string")).withColumn("KEEP", F.lit("mine"))
    got = quality.judged(odd, quality.learn(odd, sample=200))
    assert got.count() == 1203 and [c for c in got.columns if c.lower() == "keep"] == ["keep"]


def test_expectation_maximisation_plain():
    """The estimate equals the same steps written as loops over patterns and labellers."""
    r = np.random.default_rng(4)
    patterns = np.unique(r.integers(0, 3, (60, len(quality.LABELLERS))), axis=0)
    counts = r.integers(1, 50, len(patterns))
    post, chance, share = quality.estimate(patterns, counts, rounds=25)
    p = [1 / (1 + np.exp(-((row == quality.GOOD).sum() - 3.0 * (row == quality.BAD).sum()))) for row in patterns]
    for _ in range(25):
        ch = [[[1.0, 1.0], [1.0, 1.0]] for _ in quality.LABELLERS]
        total = [0.0, 0.0]
        for row, n, q in zip(patterns, counts, p, strict=True):
            for c, w in ((0, n * (1 - q)), (1, n * q)):
                total[c] += w
                for j, v in enumerate(row):
                    if v != quality.NONE:
                        ch[j][c][v] += w
        ch = [[[x / sum(c) for x in c] for c in j] for j in ch]
        s = min(max(total[1] / sum(total), 1e-4), 1 - 1e-4)
        new = []
        for row in patterns:
            z = [np.log(1 - s), np.log(s)]
            for j, v in enumerate(row):
                if v != quality.NONE:
                    z = [z[c] + np.log(ch[j][c][v]) for c in (0, 1)]
            new.append(1 / (1 + np.exp(np.clip(z[0] - z[1], -50, 50))))
        if max(abs(a - b) for a, b in zip(new, p, strict=True)) < 1e-7:
            break
        p = new
    assert np.allclose(post, p, atol=1e-6) and abs(share - s) < 1e-9 and np.allclose(chance, ch, atol=1e-9)


PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(31)
    words = [word(r, ["ka", "lo", "mi", "ren", "tu", "vas"], 3) for _ in range(400)]
    say = lambda n: [r.choice(words) for _ in range(n)]
    item = say(30)
    rows = []
    for i in range(120):
        body = say(r.choice([3, 40, 80]))
        if i % 6 == 0:
            body = rows[r.randrange(len(rows))][1].split() if rows else body
            for _ in range(r.randrange(4)):
                body[r.randrange(len(body))] = f"edit{r.randrange(10**6)}"
        if i % 11 == 0:
            body = body[:10] + item[2:20] + body[10:]
        if i % 4 == 0:
            body = [*body, f"+1 (988) 555-{1000 + i}", "end"]
        rows.append((500 - i, " ".join(body)))
    return [*rows, (1000, "!!! 123"), (1001, None), (1002, "")], " ".join(item)


def test_pipeline_plain(spark, corpus, tmp_path):
    import sentencepiece

    import corpus_pipeline

    rows, item = corpus
    folder = str(tmp_path / "sf")
    spark.createDataFrame([(i, x, "en", None, 5, "mine", "b") for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long, Spans string, n_words string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = {x.doc_id: list(x.ids) for x in corpus_pipeline.run(spark, folder).collect()}

    kept = {i: x for i, x in rows if re.search(r"[^\W\d_]", x or "")}
    grams = lambda x, n: {tuple(w[k : k + n]) for w in [x.lower().split()] for k in range(max(1, len(w) - n + 1))}
    sets, root = {i: grams(x, 5) for i, x in kept.items()}, {i: i for i in kept}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if root[j] < root[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    root[i], changed = root[j], True
    kept = {i: x for i, x in kept.items() if root[i] == i}
    windows = grams(item, 13)

    def contaminated(x):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.lower())
        hit = {p for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for p in range(k, k + 13)}
        return len(hit) > 0 and 20 * len(hit) >= len(w)

    kept = {i: PHONE.sub("<PHONE>", x) for i, x in kept.items() if not contaminated(x)}
    m = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    assert 60 < len(kept) < 115 and out == {i: m.encode(x) for i, x in kept.items()}
    # stages but the last keep the documents' columns, whatever their names
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "Spans", "n_words"] and docs.where("Spans <> 'mine' or n_words <> 'b'").isEmpty()


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path / "sf")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).isEmpty()


def test_pipeline_odd_rows(spark, tmp_path):
    """Null ids, null texts, repeated ids and rows, one very long text."""
    import corpus_pipeline

    r = random.Random(33)
    long = " ".join(word(r, ["ka", "lo", "mi"], 4) for _ in range(40_000))
    folder = str(tmp_path / "sf")
    rows = [(None, "lorem ipsum dolor"), (None, None), (1, "one text of a doubled id"), (1, "and another text here"), (2, long), (3, long + " x"), (4, "same rows"), (4, "same rows"), (5, "x" * 20_000)]
    spark.createDataFrame([(*x, None, None, None) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "nothing of it")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    # nothing can be learned without languages, so every row is und and goes
    assert not out
    named = [(i, x, "la") for i, x in rows]
    spark.createDataFrame([(*x, None, None) for x in named], "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    out = sorted((x.doc_id is not None, x.doc_id or 0) for x in corpus_pipeline.run(spark, folder).collect())
    assert out == [(False, 0), (True, 1), (True, 1), (True, 2), (True, 4), (True, 4), (True, 5)]


def test_shingles_and_hashes_plain():
    """Equal words and windows have equal hashes, wherever they stand in a slice."""
    texts = ["a b c d e f", "x a b c d e", "", "é é é é é é", "A  b\tc d e"]
    import pyarrow as pa

    found = {}
    for lo, _, buf, offs in t.slices(pa.array(texts)):
        for row, g in zip(*jaccard.shingles(buf, offs, 5), strict=True):
            found.setdefault(lo + int(row), set()).add(int(g))
    want = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in enumerate(x.lower().split() for x in texts) if w}
    assert all(len(found[i]) == len(want[i]) for i in want) and all(len(found[i] & found[j]) == len(want[i] & want[j]) for i in want for j in want)
