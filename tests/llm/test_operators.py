"""Operators against brute force, and their defined edge cases."""

import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from millrace.llm import ann, chat, langid, licenses, linededup, mixing, quality, simhash, spm, topk
from tests.llm.test_queries import brute_component

DOC = "doc_id long, text string, lang string, source string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()


def docs(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


def odd_texts():
    return [None, "", " \n\t ", "one", "two words", "x" * 5000, "word " * 3000, "a\n\n\nb", "日本語 テキスト 🎉", "MIT License"]


def odd_docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s") for i, t in enumerate(odd_texts())]
    rows += [rows[4], (None, "no id", "en", "s"), (None, None, None, None)]
    return docs(spark, rows)


# SimHash ------------------------------------------------------------------


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_definition(spark):
    for text in [*odd_texts(), "The The the\x0bTHE É\x85é x"]:
        assert simhash.text_fingerprint(text) == slow_fingerprint(text)
    hashed = spark.range(1).select(F.xxhash64(F.lit("abc é"))).first()[0]
    assert hashed % 2**64 == xxhash.xxh64_intdigest("abc é", seed=42)


@pytest.mark.parametrize(("tile", "many"), [(2048, 10**9), (3, 10**9), (3, 1)])
def test_links_span_the_brute_force_components(spark, monkeypatch, tile, many):
    monkeypatch.setattr(simhash, "MANY_FINGERPRINTS", many)
    rng = random.Random(1)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in values[:20]:
        for _ in range(6):
            v ^= 1 << rng.randrange(64)
            values.append(v)
    values += [0, (1 << 64) - 1, 1 << 63, 3 << 62]
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    links = simhash.near_links(frame, tile_rows=tile)
    groups = {r["node"] % 2**64: r["component"] for r in simhash.connected_components(links).collect()}
    expected = brute_component(dict(zip(values, values, strict=True)))
    for a in values:
        for b in values:
            assert (expected[a] == expected[b]) == (a == b or (a in groups and groups.get(a) == groups.get(b)))


def test_near_duplicates_of_odd_rows(spark):
    frame = odd_docs(spark).withColumn("fingerprint", F.lit("clash"))
    found = simhash.near_duplicates(frame).collect()
    assert len(found) == frame.count()
    by_id = {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None}
    assert by_id[0] == by_id[1] == by_id[2] == 0 and by_id[3] == 3
    kept = simhash.keep_first(odd_docs(spark)).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [0, 3, 4, 5, 6, 7, 8, 9]
    assert [r["text"] for r in kept if r["doc_id"] is None] == ["no id"]
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


def test_one_group_of_many_copies(spark):
    rows = [(i, "the same few words in every copy", "en", "s") for i in range(300)]
    rows += [(1000 + i, " ".join(random.Random(i).choices(WORDS, k=40)), "en", "s") for i in range(20)]
    found = simhash.near_duplicates(docs(spark, rows)).collect()
    assert {r["component_id"] for r in found if r["doc_id"] < 300} == {0}


@pytest.mark.parametrize("tile", [512, 2])
def test_similar_texts_equal_brute_force(spark, tile):
    import corpus_pipeline

    rng = random.Random(9)
    rows = []
    for base in range(12):
        words = rng.choices(WORDS, k=120)
        for _ in range(4):
            copy = list(words)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(120)] = f"new{rng.randrange(99)}"
            rows.append((len(rows), " ".join(copy), "en", "s"))
    rows += [(90, None, "en", "s"), (91, " ", "en", "s"), (92, "two words", "en", "s"), (93, "Two  words", "en", "s"), (94, "two other", "en", "s")]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t, _, _ in rows}
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sets:
            union = sets[a] | sets[b]
            if a < b and (not union or len(sets[a] & sets[b]) / len(union) >= 0.8):
                old, low = max(group[a], group[b]), min(group[a], group[b])
                group = {i: low if g == old else g for i, g in group.items()}
    frame = docs(spark, rows)
    found = simhash.similar_texts(frame, tile_rows=tile).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == group and len(found) == len(rows)
    kept = corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()
    assert {r["doc_id"] for r in kept} == {i for i in group if group[i] == i} and len(kept) < len(rows) - 10


def test_fingerprints_propose_what_no_band_does(spark):
    import corpus_pipeline

    # 20 of 25 shingles shared, no band shared, fingerprints 2 bits apart
    words = [f"w51113879x{i}" for i in range(29)]
    texts = " ".join(words), " ".join(words[:24])
    sets = [np.unique(simhash.shingle_hashes(t, 5)) for t in texts]
    assert not set(simhash.band_hashes(sets[0])) & set(simhash.band_hashes(sets[1]))
    frame = docs(spark, [(3, texts[1], "en", "s"), (1, texts[0], "en", "s"), (2, "some other text of six words", "en", "s")])
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(frame).collect()} == {1: 1, 2: 2, 3: 1}
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()) == [1, 2]


def test_few_links_take_no_rounds_and_many_give_the_same(spark, monkeypatch):
    rng = random.Random(6)
    pairs = [(a, b) for a, b in ((rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)) if a != b]
    links = spark.createDataFrame(pairs, "src long, dst long").repartition(3)
    rounds, by_rounds = [], simhash.connected_components
    monkeypatch.setattr(simhash, "connected_components", lambda x: rounds.append(1) or by_rounds(x))
    few = sorted(map(tuple, simhash.joined_groups(links).collect()))
    assert not rounds and few
    monkeypatch.setattr(simhash, "FEW_LINKS", 10)
    assert sorted(map(tuple, simhash.joined_groups(links).collect())) == few and rounds
    monkeypatch.undo()
    assert simhash.joined_groups(links.limit(0)).collect() == []


def test_similar_texts_of_odd_rows(spark):
    found = simhash.similar_texts(odd_docs(spark)).collect()
    assert len(found) == odd_docs(spark).count()
    assert {r["component_id"] for r in found if r["doc_id"] in (0, 1, 2)} == {0}
    assert simhash.similar_texts(docs(spark, [])).collect() == []


# Language ID --------------------------------------------------------------


def lang_rows(n=240):
    rng = random.Random(4)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["str", "ung", "sch", "ter"]}
    out = []
    for i in range(n):
        lang = "aa" if i % 2 else "bb"
        out.append((i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(30)), lang, "s"))
    return out


def test_language_is_learnt_and_held_out_rows_agree(spark):
    frame = docs(spark, lang_rows())
    model = langid.train(frame)
    found = langid.identify(frame, model).collect()
    assert model.langs == ("aa", "bb")
    assert sum(r["lang_pred"] == r["lang"] for r in found) / len(found) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found) and not any(r["rejected"] for r in found)


def test_chunked_scoring_equals_features(monkeypatch):
    import pyarrow as pa

    model = langid.fit([(t, lang) for _, t, lang, _ in lang_rows(80)])
    texts = ["", "ka", *[t for _, t, _, _ in lang_rows(6)], "x", "é", "ungung lo", "  "]
    plain = []
    for t in texts:
        ids, share = langid.features(t)
        plain.append(model.table[:, ids] @ share + model.bias)
    plain = model.probabilities(np.array(plain))
    for size in (7, 64, 1 << 20):
        monkeypatch.setattr(langid, "CHUNK_BYTES", size)
        assert np.allclose(langid.score_texts(model, pa.array(texts)), plain)
        sliced = pa.array(["skip", *texts]).slice(1)
        assert np.allclose(langid.score_texts(model, sliced), plain)


def test_language_of_odd_rows(spark):
    frame = odd_docs(spark).withColumns({"lang_pred": F.lit(1), "rejected": F.lit("x")})
    model = langid.fit([(t, lang) for _, t, lang, _ in lang_rows(40)])
    found = langid.identify(frame, model).collect()
    assert len(found) == frame.count()
    for r in found:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or (r["score"] == 0 and r["rejected"]))
    assert {r["lang_pred"] for r in langid.identify(frame, None).collect()} == {"und"}
    assert langid.train(docs(spark, [])) is None
    assert langid.identify(docs(spark, []), model).collect() == []


def test_held_out_fold(spark):
    import zlib

    frame = docs(spark, [(i, "t", "en", "s") for i in range(50)] + [(None, "t", "en", "s")])
    for r in frame.withColumn("f", langid.fold_of()).collect():
        assert r["f"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)


# Line dedup ---------------------------------------------------------------


def slow_windows(lines):
    found = [(p, tuple(lines[p : p + 3])) for p in range(len(lines) - 2)]
    if 0 < len(lines) < 3:
        found.append((0, tuple(lines)))
    if len(lines) > 1:
        found += [(p, (x,)) for p, x in enumerate(lines) if x.count(" ") >= linededup.LONG_LINE_BLANKS]
    return [(p, w) for p, w in found if any(x.strip(" ") for x in w)]


def slow_dedup(rows):
    """rows: (key, text) in order of the keys, which are unique."""
    seen, out = {}, {}
    split = {i: t.split("\n") if t is not None else [] for i, t in rows}
    for i in sorted(split):
        for p, w in sorted(slow_windows(split[i])):
            seen.setdefault(w, (i, p))
    for i, lines in split.items():
        gone = set()
        for p, w in slow_windows(lines):
            if seen[w] != (i, p):
                start = max(p, seen[w][1] + len(w)) if seen[w][0] == i else p
                gone |= set(range(start, p + len(w)))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 14)))) for i in range(60)]
    rows += [(100, "x\nx\nx\nx\nx\nx"), (101, "x\nx\nx"), (102, "\n\n\n\n"), (103, ""), (104, "p\nq")]
    long = " ".join(f"w{k}" for k in range(51))
    rows += [(105, "p\nq"), (106, f"u\n{long}\nv\nz"), (107, long), (108, f"{long}\ny"), (109, f"o\n{long}\n{long}\nn"), (110, long + " more"), (111, long[:-4])]
    found = linededup.dedup_lines(docs(spark, rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in found} == slow_dedup(rows)


def test_lines_of_one_id_and_clashing_names(spark):
    rows = [(1, "a\nb\nc\nd"), (1, "a\nb\nc\ne"), (1, "a\nb\nc\ne"), (2, "b\nc\ne"), (None, "k\nl\nm"), (None, "k\nl\nm\nn")]
    frame = docs(spark, rows, "doc_id long, text string")
    names = ["key", "lines", "gone", "own_id", "own_h", "_id", "_gone", "_k", "_lines", "n_lines"]
    found = linededup.dedup_lines(frame.withColumns({n: F.lit("mine") for n in names})).collect()
    assert all(r[n] == "mine" for r in found for n in names if n != "n_lines")
    order = {t: r[0] for r in frame.selectExpr("xxhash64(text)", "text").collect() for t in [r[1]]}
    keyed = {((-1 if i is None else i), order[t]): t for i, t in rows}
    expected = slow_dedup(sorted(keyed.items()))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in found) == sorted(
        ((-1 if i is None else i), expected[(-1 if i is None else i), order[t]]) for i, t in rows
    )


def test_lines_of_odd_rows(spark):
    frame = odd_docs(spark).withColumn("n_lines", F.lit("clash"))
    found = linededup.dedup_lines(frame).collect()
    assert len(found) == frame.count()
    assert {r["text"] for r in found if r["doc_id"] == 0} == {None}
    assert linededup.dedup_lines(docs(spark, [])).collect() == []


# Mixing -------------------------------------------------------------------


def slow_share(budget, children):
    """children: name -> (cap, weight); fills until nothing is left to give."""
    share = dict.fromkeys(children, 0.0)
    left, open_ = budget, set(children)
    while open_ and left > 1e-9:
        total = sum(children[c][1] for c in open_)
        given = 0.0
        for c in sorted(open_):
            part = min(left * children[c][1] / total, children[c][0] - share[c])
            share[c] += part
            given += part
        left -= given
        open_ = {c for c in open_ if children[c][0] - share[c] > 1e-9}
    return share


def test_water_filling_redistributes_shortage(spark):
    children = {"a": (10, 5.0), "b": (100, 1.0), "c": (30, 2.0), "d": (0, 1.0)}
    frame = spark.createDataFrame([(0, n, c, w, 90.0) for n, (c, w) in children.items()], "root int, name string, cap long, weight double, budget double")
    found = {r["name"]: r["share"] for r in mixing.share_out(frame, ["root"], "name").collect()}
    expected = slow_share(90.0, children)
    assert found == pytest.approx(expected) and sum(found.values()) == pytest.approx(90.0)


def test_mixture_meets_budgets_and_is_whole(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 9), rng.choice(["en", "de", None]), rng.choice(["s", "t", None])) for i in range(400)]
    frame = docs(spark, rows)
    found = mixing.mix(frame, F.lit("one"), 0.5, 1).collect()
    size = {i: len(t.split()) for i, t, _, _ in rows}
    assert 0.45 * sum(size.values()) < sum(size[r["doc_id"]] for r in found) <= 0.5 * sum(size.values())
    twice = mixing.mix(frame, F.lit("one"), 5.0, 2).collect()
    assert sorted(r["doc_id"] for r in twice) == sorted(size) and {r["copies"] for r in twice} == {2}


def test_mixture_of_odd_rows(spark):
    frame = odd_docs(spark).withColumn("copies", F.lit("clash"))
    assert mixing.mix(frame, F.col("source"), 0.5).count() <= frame.count()
    assert mixing.mix(docs(spark, []), F.lit("one"), 0.5).collect() == []


# SentencePiece ------------------------------------------------------------


def test_encoding_equals_the_library(spark):
    model = spm.read_model()
    library = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL_PATH)
    texts = [*odd_texts(), "  a   b\n\n  c ", " a\n b \nc\n\nd.", "x...y,, 3.5 (z)", "z" * 700 + " " * 40, "\n", "it's \"so\". Yes, ².", "a▁b"]
    frame = docs(spark, [(i, t) for i, t in enumerate(texts)] + [(3, "one")], "doc_id long, text string")
    found = spm.encode(frame, model).collect()
    assert len(found) == len(texts) + 1
    for r in found:
        assert list(r["ids"]) == library.encode(texts[r["doc_id"]] or "")
    restored = spm.encode(frame, model).select("doc_id", spm.restore(spm.decode(F.col("ids"), model), model).alias("t")).collect()
    for r in restored:
        assert r["t"] == (texts[r["doc_id"]] or "").replace("▁", " ")
    report = {r["doc_id"]: r for r in spm.encoding_report(frame, model).collect()}
    for i, t in enumerate(texts):
        assert report[i]["n_pieces"] == len(library.encode(t or "")) and report[i]["round_trip"] == ("▁" not in (t or ""))
    assert spm.encoding_report(docs(spark, [], "doc_id long, text string"), model).collect() == []


def test_texts_that_begin_with_a_stop_equal_the_library(spark):
    model = spm.read_model()
    library = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL_PATH)
    texts = [s + t for s in ".," for t in ("net is", "foo", "", " x", s + "y")]
    frame = docs(spark, list(enumerate(texts)), "doc_id long, text string")
    for r in spm.encode(frame, model).collect():
        assert list(r["ids"]) == library.encode(texts[r["doc_id"]])


def test_digest_tells_order_and_hot_words_do_not_change_it(spark, monkeypatch):
    model = spm.read_model()
    rows = [(1, "one two three"), (2, "two one three"), (3, "one two three"), (4, "rare weird woords here")]
    frame = docs(spark, rows, "doc_id long, text string")
    whole = {r["doc_id"]: tuple(r) for r in spm.encoding_report(frame, model).collect()}
    assert whole[1][4] == whole[3][4] != whole[2][4]
    monkeypatch.setattr(spm, "HOT_WORDS", 3)
    assert {r["doc_id"]: tuple(r) for r in spm.encoding_report(frame, model).collect()} == whole


def slow_viterbi(word, pieces, worst):
    best = [(0.0, 0, None)] + [(-1e18, 0, None)] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            part = word[start:end]
            score = pieces.get(part, worst if end - start == 1 else None)
            if score is not None and best[start][0] + score > best[end][0]:
                best[end] = (best[start][0] + score, start, part)
    out, at = [], len(word)
    while at:
        out.append(best[at][2])
        at = best[at][1]
    return out[::-1]


def test_viterbi_fold_finds_the_best_path(spark):
    rng = random.Random(6)
    names = ["a", "b", "ab", "ba", "aab", "bab", "abba", "c", "▁", "▁a", "▁ab"]
    scores = {p: -rng.uniform(1, 9) for p in names}
    model = spm.PieceModel((("<unk>", 0.0, spm.UNKNOWN), *((p, s, spm.NORMAL) for p, s in scores.items())), spm.UNIGRAM)
    words = ["▁" + "".join(rng.choices("abcz", k=rng.randrange(0, 9))) for _ in range(40)]
    frame = spark.createDataFrame([(w,) for w in sorted(set(words))], "word string")
    known = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    for r in spm.encode_words(frame, model).collect():
        path = slow_viterbi(r["word"], scores, min(scores.values()) - spm.UNKNOWN_PENALTY)
        assert list(r["ids"]) == [known.get(p, 0) for p in path]


# Top-k and neighbours -----------------------------------------------------


def test_top_k_equals_brute_force_with_ties():
    rng = np.random.default_rng(3)
    for n, top in ((1, 5), (7, 3), (300, 900)):
        x = rng.integers(-top, top, (n, 6)).astype(float)
        x[n // 2 :] = x[: n - n // 2]
        ids = rng.permutation(n) * 3
        got = topk.search_tile(ids, x, ids[:5], x[:5], 10)
        expected = []
        for i in range(min(5, n)):
            s = (x @ x[i]).astype(int)
            order = [j for j in np.lexsort((ids, -s)) if j != i][:10]
            expected += [(int(ids[i]), int(ids[j]), int(s[j])) for j in order]
        assert got == expected


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_unsound_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    table = vectors(spark, [(0, [1.0, 0.5], 1), (100, [0.5, -0.5], 1), (2, [nan, 1.0], 1), (3, [inf, 1.0], 1), (4, [None, 1.0], 1), (5, None, 1), (6, [0.0, 0.0], 1), (7, [1.0], 1), (None, [1.0, 1.0], 1)])
    rows = topk.quantized(table)
    found = topk.top_k(rows.where("id % 100 = 0"), rows).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found} == {
        (0, 1, 100, 262144), (0, 2, 6, 0), (100, 1, 0, 262144), (100, 2, 6, 0),
    }
    assert topk.top_k(rows.where("false"), rows.where("false")).collect() == []


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24))
    x[1000:1400] = x[1000]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    found = ann.search(frame, frame.where("id % 20 = 0"), k=10).toPandas()
    hits = 0
    for q, group in found.groupby("query_id"):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(3000), -s))[:10]) & set(group["vec_id"]))
        assert q not in set(group["vec_id"]) and np.allclose(group["score"], s[group["vec_id"]])
        group = group.sort_values("rank")
        assert list(group["rank"]) == list(range(1, 11))
        assert group.sort_values(["score", "vec_id"], ascending=[False, True])["vec_id"].tolist() == group["vec_id"].tolist()
    assert hits / (10 * found["query_id"].nunique()) >= 0.9


def test_few_vectors_are_all_found(spark):
    frame = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)] + [(None, [1.0, 1.0])], "id long, v array<double>")
    found = ann.search(frame, frame.where("id = 0")).collect()
    assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"])] == [1, 2, 3, 4]
    assert ann.search(frame.where("false"), frame.where("false")).collect() == []


# Chat ---------------------------------------------------------------------


def test_escapes_are_reversible():
    import re

    rng = random.Random(2)
    parts = ["\\", "<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "\n", "n", "<", "|", "x", "[", "<|turn|>", "<|end|>\n"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(8)))
        assert chat.unescape(chat.escape(text)) == text and not re.search(chat.CONTROL, chat.escape(text))
        assert chat.unescape(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_windows_keep_budget_system_history_and_targets(spark):
    rng = random.Random(3)
    turns = [(1, 0, "system", "be brief")]
    turns += [(1, i, "user" if i % 2 else "assistant", "word " * rng.randrange(1, 90)) for i in range(1, 60)]
    turns += [(2, 0, None, None), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (3, 0, "user", "y" * 9000), (None, 0, "user", "q")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    found = chat.windows(table, budget=200, history_tokens=60).collect()
    cost = lambda t: -(-len(t.encode()) // 4) + 4
    mine = sorted((r for r in found if r["conv_id"] == 1), key=lambda r: r["window"])
    assert len(mine) > 3
    targets = []
    for r in mine:
        parsed = chat.parse(r["text"])
        assert parsed[0] == ("system", "be brief") and r["n_repeated"] + r["n_new"] == len(parsed)
        assert sum(cost(t) for _, t in parsed) <= 200
        assert r["n_repeated"] <= 1 + chat.HISTORY_TURNS
        targets += [chat.unescape(r["text"][s["begin"] : s["end"]]) for s in r["spans"]]
    assert targets == [t for _, _, role, t in turns[:60] if role == "assistant"]
    assert {r["conv_id"] for r in found} == {1, 2, 3, None}
    direct = chat.read_back(chat.windows(table), in_order=True).collect()
    assert sorted(map(str, direct)) == sorted(map(str, chat.read_back(chat.windows(table)).collect()))
    assert chat.windows(table.where("false")).collect() == []


# Quality ------------------------------------------------------------------


def test_quality_separates_and_shrinks(spark):
    rng = random.Random(7)
    good = lambda: " ".join(rng.choices(WORDS, k=60)) + "."
    bad = lambda: " ".join(w + "%%%" for w in rng.choices(WORDS[:3], k=60))
    rows = [(i, bad() if i % 4 == 0 else good(), "en", f"s{i % 5}") for i in range(400)]
    frame = docs(spark, rows)
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(frame, labels)
    found = quality.classify(frame, model, F.col("source"), F.col("lang")).collect()
    assert all(r["keep"] == (r["doc_id"] % 4 != 0) for r in found) and all(0 <= r["quality"] <= 1 for r in found)


def test_sparse_sites_stay_near_the_prior(spark):
    rows = [(i, f"h{i % 4}", f"h{i % 4}/p", 0.9 if i % 4 < 2 else 0.1) for i in range(400)] + [(900, "lone", "lone/p", 0.99)]
    frame = spark.createDataFrame(rows, "id long, host string, path string, p double")
    found = {r["id"]: r for r in quality.shrink(frame).collect()}
    overall = sum(r[3] for r in rows) / len(rows)
    assert abs(found[0]["path_score"] - 0.9) < 0.03
    assert overall < found[900]["host_score"] < 0.9
    assert found[900]["path_score"] < 0.99


def test_quality_of_odd_rows(spark):
    model = quality.fit(np.empty((0, 8)), np.empty(0), tuple(quality.measures(F.lit("x"))))
    frame = odd_docs(spark).withColumn("quality", F.lit("clash"))
    assert len(quality.classify(frame, model, F.col("source"), F.col("lang")).collect()) == frame.count()
    assert quality.classify(docs(spark, []), model, F.col("source"), F.col("lang")).collect() == []


# Licenses -----------------------------------------------------------------


def test_licenses_equal_brute_force(spark):
    import re

    rng = random.Random(5)
    bag = sorted({w for t in licenses.TEMPLATES.values() for w in t.split()})
    rows = [(i, "\n".join(" ".join(rng.choices(bag, k=rng.randrange(1, 25))) for _ in range(3))) for i in range(80)]
    for i, t in enumerate(licenses.TEMPLATES.values()):
        words = t.split()
        rng.shuffle(words)
        rows += [(200 + i, t.upper()), (300 + i, " ".join(words[1:])), (400 + i, " ".join(words[len(words) // 3 :]))]
    filler = " ".join(rng.choices(WORDS, k=900))
    spread = [f" {w} ".join(["", *[" ".join(rng.choices(WORDS, k=300))] * 1, ""]) for w in licenses.TEMPLATES["cc-by-nc-4.0"].split()]
    rows += [(600, " ".join(spread)), (601, f"{filler} {licenses.TEMPLATES['isc']} {filler}"), (602, "this wor\u212a is licensed under a creative commons attribution 4 0 international license \u0130s")]
    rows += [(500, "MIT\nLicense, mit-license!"), (501, "permit license"), (502, None), (503, "general public general public license")]
    for r in licenses.scan(docs(spark, rows, "doc_id long, text string")).collect():
        text = re.sub("[A-Z]", lambda m: m[0].lower(), dict(rows)[r["doc_id"]] or "")
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        base = [(i, lab) for i in range(len(ws)) for ph, lab in licenses.PHRASES.items() if ws[i : i + len(ph.split())] == ph.split()]
        near, best = set(), 0.0
        for label, t in licenses.TEMPLATES.items():
            want, span = set(t.split()), licenses.SPREAD * len(t.split())
            share = max((len(want & set(ws[i : i + span])) for i in range(len(ws))), default=0) / len(want)
            if share >= licenses.THRESHOLD - 1e-9:
                near.add(label)
                best = max(best, share)
        assert r["n_words"] == len(ws) and r["n_base"] == len(base)
        assert r["first_word"] == min((i for i, _ in base), default=None) and r["last_word"] == max((i for i, _ in base), default=None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in base}))
        assert r["labels"] == ",".join(sorted({x for _, x in base} | near))
        assert r["score"] == pytest.approx(1.0 if base else best)


def test_wrapped_notices_are_found_whole(spark):
    import textwrap

    rng = random.Random(12)
    rows, expected = [], {}
    for label, text in licenses.TEMPLATES.items():
        for width in (20, 60):
            for before in (0, 45, 130):
                around = lambda n: "\n".join(textwrap.wrap(" ".join(rng.choices(WORDS, k=n)), 60))
                wrapped = "\n * ".join(textwrap.wrap(text, width))
                expected[len(rows)] = label
                rows.append((len(rows), f"{around(before)}\n{wrapped}\n{around(70)}"))
    found = {r["doc_id"]: r for r in licenses.scan(docs(spark, rows, "doc_id long, text string")).collect()}
    for i, label in expected.items():
        assert label in found[i]["labels"].split(",") and found[i]["score"] == 1.0


def test_licenses_of_odd_rows(spark):
    frame = odd_docs(spark).withColumn("labels", F.lit("clash"))
    found = licenses.scan(frame).collect()
    assert len(found) == frame.count() and sum(r["n_base"] for r in found) == 1
    assert licenses.scan(docs(spark, [])).collect() == []


# Languages beyond the dimensions -----------------------------------------


def test_every_one_of_many_languages_can_be_predicted(spark):
    rng = random.Random(31)
    parts = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(4)] for _ in range(300)]
    rows = [(i, " ".join(rng.choices(parts[i % 300], k=40)), f"l{i % 300:03}", "s") for i in range(3000)]
    frame = docs(spark, rows)
    model = langid.train(frame)
    assert len(model.langs) == 300 and len(model.table) == langid.DIM
    found = langid.identify(frame, model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) / len(found) > 0.9


def test_held_out_accuracy_of_the_query(spark, data_dir):
    found = langid.op4_langid(spark, data_dir)
    truth = spark.read.parquet(f"{data_dir}/documents.parquet").where("lang is not null").select("doc_id", "lang")
    held = found.where("held_out").join(truth, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95


def test_lower_case_of_every_letter(spark):
    import sys

    rows = [(chr(c),) for c in range(128, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    low = spark.createDataFrame(rows, "c string").select("c", licenses.lowered(F.col("c")).alias("low"))
    assert low.where(F.col("low").rlike(r"[\x00-\x7F]")).isEmpty()


# Repeated rows, ids and names ---------------------------------------------


def test_first_rows_lose_nothing_unlike(spark):
    rows = [(None, "one red fox", "en", "s"), (None, "two blue hens", "en", "s"), (None, "three old men", "en", "s")]
    rows += [(7, "first text of seven", "en", "s"), (7, "another text under it", "en", "s"), (7, "another text under it", "en", "s")]
    rows += [(8, "One red fox", "en", "s"), (9, "three old men", "en", "s")]
    frame = docs(spark, rows).withColumns({n: F.lit("mine") for n in ("_row", "_key", "key_id", "own_h", "component")})
    for groups in (None, simhash.similar_groups(frame)):
        kept = simhash.keep_first(frame, groups=groups)
        assert kept.columns == frame.columns
        found = sorted((str(r["doc_id"]), r["text"], r["own_h"], r["component"]) for r in kept.collect())
        assert found == sorted(
            (str(i), t, "mine", "mine")
            for i, t in [(None, "two blue hens"), (7, "first text of seven"), (7, "another text under it"), (8, "One red fox"), (9, "three old men")]
        )


def test_scores_of_large_components_are_exact(spark):
    rows = [(0, [200000.0]), (1, [200000.0]), (2, [300000.0]), (3, [-3e38]), (4, [3e38]), (4, [3e38]), (5, [1e38])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = topk.quantized(frame)
    found = topk.top_k(vectors.where("id = 0"), vectors, 4).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"])] == [
        (1, 4, 2**63 - 1), (2, 4, 2**63 - 1), (3, 5, 2**63 - 1), (4, 2, 204800000 * 307200000),
    ]


def test_tiles_share_a_bar_and_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.integers(-900, 900, (700, 8)).astype(float)
    x[600:] = x[:100]
    monkeypatch.setattr(topk, "TILE_ROWS", 20)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3, x[3].tolist())] * 3
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    found = topk.top_k(frame.where("id % 100 = 0"), frame).collect()
    ids = np.array([i for i, _ in rows])
    every = np.array([v for _, v in rows])
    for q in range(0, 700, 100):
        s = (every @ x[q]).astype(int)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:10]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert got == [(n + 1, int(ids[j]), int(s[j])) for n, j in enumerate(order)]


def test_neighbours_of_every_length_and_repeated_ids(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(90)] + [(100 + i, rng.normal(size=3).tolist()) for i in range(30)]
    frame = spark.createDataFrame([*rows, rows[5], rows[5], (7, rows[8][1])], "id long, v array<double>")
    found = ann.search(frame, frame.where("id in (5, 105)"), k=20).toPandas()
    for q, size in ((5, 90), (105, 30)):
        mine = found[found["query_id"] == q]
        assert len(mine) == 20 == mine["vec_id"].nunique() and q not in set(mine["vec_id"])
        assert ((mine["vec_id"] >= 100) == (size == 30)).all()


def test_weights_of_zero_take_nothing_and_names_may_clash(spark):
    rows = [(i, "w " * (1 + i % 5), ["en", "de", "fr"][i % 3], ["s", "t"][i % 2]) for i in range(300)]
    frame = docs(spark, [*rows, rows[0], rows[0]]).withColumns({n: F.lit("mine") for n in ("passes", "cut", "domain", "_lang", "rest")})
    found = mixing.mix(frame, F.lit("one"), 0.9, 3, lang_weights={"de": 0}, source_weights={"t": 0.0}).collect()
    assert found and all(r["lang"] != "de" and r["source"] == "s" and r["passes"] == r["cut"] == r["domain"] == "mine" for r in found)
    assert len({r["copies"] for r in found if r["doc_id"] == 0}) == 1 and sum(r["doc_id"] == 0 for r in found) in (0, 3)
    with pytest.raises(ValueError):
        mixing.mix(frame, F.lit("one"), 0.9, lang_weights={"de": -1.0})


def test_shrinking_equals_plain_sums(spark):
    rng = random.Random(21)
    rows = []
    for i in range(500):
        host = rng.choice(["a", "b", "c", None])
        rows.append((i, host, rng.choice([f"{host}/x", f"{host}/y", None]), rng.random()))
    frame = spark.createDataFrame(rows, "id long, host string, path string, p double")
    hosts, paths = {}, {}
    for _, h, t, p in rows:
        hosts.setdefault(h, []).append(p)
        paths.setdefault((h, t), []).append(p)
    overall = sum(r[3] for r in rows) / len(rows)

    def weight(groups, prior):
        some = {g: v for g, v in groups.items() if len(v) > 1}
        n = sum(map(len, some.values()))
        mean = {g: sum(v) / len(v) for g, v in some.items()}
        between = sum(len(v) * (mean[g] - prior(g)) ** 2 for g, v in some.items())
        noise = sum(max(0.0, sum(x * x for x in v) / len(v) - mean[g] ** 2) for g, v in some.items())
        unit = sum(len(v) * prior(g) * (1 - prior(g)) for g, v in some.items())
        spread = (between - noise) / n
        return quality.MOST if spread <= 0 else min(quality.MOST, max(quality.LEAST, unit / n / spread - 1))

    k = weight(hosts, lambda h: overall)
    host_score = {h: (sum(v) + k * overall) / (len(v) + k) for h, v in hosts.items()}
    d = weight(paths, lambda g: host_score[g[0]])
    odds = lambda p: np.log(min(max(p, quality.CLIP), 1 - quality.CLIP) / (1 - min(max(p, quality.CLIP), 1 - quality.CLIP)))
    for r in quality.shrink(frame).collect():
        h, t, p = r["host"], r["path"], r["p"]
        assert r["host_score"] == pytest.approx(host_score[h])
        assert r["path_score"] == pytest.approx((sum(paths[h, t]) + d * host_score[h]) / (len(paths[h, t]) + d))
        rest = (sum(hosts[h]) - p + k * overall) / (len(hosts[h]) - 1 + k)
        rest = (sum(paths[h, t]) - p + d * rest) / (len(paths[h, t]) - 1 + d)
        assert r["quality"] == pytest.approx(1 / (1 + np.exp(-(odds(p) + odds(rest) - odds(overall)))))


def test_held_out_labels_of_the_quality_query(spark, data_dir):
    found = spark.read.parquet(f"{data_dir}/documents.parquet")
    labels = spark.read.parquet(f"{data_dir}/labels.parquet")
    model = quality.train(found, labels.where("doc_id % 2 = 0"))
    odd = labels.where("doc_id % 2 = 1").select("doc_id", F.col("quality").alias("truth"))
    scored = quality.classify(found, model, F.col("source"), F.col("lang")).join(odd, "doc_id").collect()
    assert sum(r["keep"] == (r["truth"] == 1) for r in scored) / len(scored) > 0.95


# Pipeline -----------------------------------------------------------------


def test_pipeline_of_odd_and_no_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    good = [(10 + i, " ".join(rng.choices(WORDS, k=40)), "en", f"s{i % 3}") for i in range(60)]
    names = ("score", "lang_pred", "rejected", "n_lines", "n_removed", "copies", "fp", "found", "key", "passes")
    for case, rows in (("rows", [*odd_docs(spark).collect(), *good, good[0], good[0]]), ("none", [])):
        docs(spark, rows).withColumns({n: F.lit("mine") for n in names}).write.parquet(f"{tmp_path}/{case}/documents.parquet")
        frame = spark.read.parquet(f"{tmp_path}/{case}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before, frame = frame, corpus_pipeline.materialize(stage(spark, frame, ""))
            assert frame.columns == before.columns and frame.count() <= before.count()
            assert all(r[n] == "mine" for r in frame.select(*names).collect() for n in names)
        last = corpus_pipeline.run(spark, f"{tmp_path}/{case}")
        assert last.count() == frame.count() and (case == "none") == (frame.count() == 0)


def test_recall_of_the_neighbour_query(spark, data_dir):
    found = ann.op5_ann(spark, data_dir).toPandas()
    table = spark.read.parquet(f"{data_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in table if r["embedding"] and None not in r["embedding"]}
    rows = {i: v for i, v in rows.items() if np.isfinite(v).all() and v.any()}
    hits = total = 0
    for q in (i for i in rows if i % 20 == 0):
        near = sorted((-float(rows[q] @ v), i) for i, v in rows.items() if i != q and len(v) == len(rows[q]))[:20]
        hits += len({i for _, i in near} & set(found[found["query_id"] == q]["vec_id"]))
        total += len(near)
    assert hits / total >= 0.9


def test_frugal_functions_give_what_they_gave(monkeypatch):
    from millrace.llm import workers

    times = []
    monkeypatch.setattr(workers, "give_back", lambda: times.append(1))
    doubled = workers.frugal(lambda batches: (2 * x for x in batches))
    assert list(doubled(iter([1, 2, 3]))) == [2, 4, 6] and times == [1]
    early = doubled(iter([1, 2, 3]))
    assert next(early) == 2
    early.close()
    assert times == [1, 1] and list(doubled(iter([]))) == []
    monkeypatch.undo()
    workers.give_back()


def test_batches_are_bounded_in_bytes_and_hold_every_row(spark):
    from millrace.llm import workers

    spark.conf.unset(workers.BATCH_SETTING)
    texts = ["a" * 1_500_000] * 8 + ["b" * 6_000_000, "", None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    try:
        rows = workers.map_batches(docs, sizes, "n long, size long").collect()
        assert sum(r.n for r in rows) == len(texts)
        assert max(r.size for r in rows) < workers.BATCH_BYTES + 7_000_000 and len(rows) > 3
        spark.conf.set(workers.BATCH_SETTING, "123456")
        workers.bound_batches(spark)
        assert spark.conf.get(workers.BATCH_SETTING) == "123456"
    finally:
        spark.conf.unset(workers.BATCH_SETTING)
