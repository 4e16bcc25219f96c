"""Corpus operators against brute force, round trips and held-out accuracy on small fixtures."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

import corpus_pipeline
from offerloom.llm import bpe, embeddings, fingerprint, langid, minhash, mixing, pages, queries, secrets, tokencount, toxicity
from offerloom.llm.graph import components

SF = "/root/testdata/sf0.001"
HARD = [None, "", " \t\n", "a", "É 🙂\n\nß", "word " * 3000, "x" * 4000, "same text here", "same text here", "null\x00byte", "１２ ½    z"]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, pieces string, id bigint"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 3}", None, "p", 7) for i, t in enumerate(HARD)]
    rows += [rows[5], (None, "no id at all", "en", "s1", 1, "p", 7), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path(queries.TOKENIZER))


@pytest.fixture(scope="module")
def encoding(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, none, ranks, encoding):
    got = sorted(map(tuple, bpe.token_digests(docs, ranks, public_tokenizers.PATTERN).collect()), key=str)
    want = []
    for doc in docs.collect():
        ids = encoding.encode_ordinary(doc.text or "")
        want.append((doc.doc_id, len(ids), sha(",".join(map(str, ids))), sha(doc.text or "")))
    assert got == sorted(want, key=str)
    assert bpe.token_digests(none, ranks, public_tokenizers.PATTERN).count() == 0


def test_bpe_slices(spark, ranks, encoding):
    """Rows beyond the first slice of an Arrow batch, and letters and numbers of Unicode 14 to 16."""
    texts = [f"row {i} of many" if i % 7 else None for i in range(2 * langid.BATCH_ROWS + 5)]
    texts += ["a\u0870\u0889b ", "x\U000105c0y \U00011bf9 1\U0001ccf5", "a\u088fb\u0600"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    got = sorted(map(tuple, bpe.token_digests(docs, ranks, public_tokenizers.PATTERN).collect()))
    ids = [encoding.encode_ordinary(t or "") for t in texts]
    assert got == [(i, len(ids[i]), sha(",".join(map(str, ids[i]))), sha(t or "")) for i, t in enumerate(texts)]


def test_bpe_folds_agree(spark, ranks, encoding):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé the") for _ in range(rng.randint(1, 90))) for _ in range(60)] + ["a" * 300]
    merger = bpe.Merger(ranks)
    for word in words:
        single = [merger.single[b] for b in word.encode()]
        assert merger._scan(list(single)) == merger._heap(list(single)) == encoding._encode_single_piece(word.encode())
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", bpe.merge_fold(F.col("w"), ranks).alias("ids")).collect()
    assert all(r.ids == encoding._encode_single_piece(r.w.encode()) for r in rows)


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) or frozenset([tuple(words)] if words else [])


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_minhash_against_all_pairs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 6, 12, 60, 200]))]
        for _ in range(6):
            text = [rng.choice(words) if rng.random() < rng.choice([0, 0.02, 0.06]) else w for w in base]
            rows.append((len(rows), " ".join(text)))
    rows += [(1000, None), (1001, ""), (1002, rows[0][1].upper()), (-5, rows[7][1])]
    sets = {i: shingles(t, 2) for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = brute_components(sets, linked)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), minhash.MinHash(words=2)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_minhash_edges(docs, none):
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == docs.count() and minhash.near_duplicates(none).count() == 0
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[8].component_id == 7 and not by_id[8].kept and by_id[0].n_shingles == by_id[2].n_shingles == 0
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)


def test_components(spark):
    nodes = spark.range(40)
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 25), (25, 30), (3, 3)], "a bigint, b bigint")
    got = {r.id: r.component for r in components(nodes, edges).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[30] == 25 and got[39] == 39


def test_secrets(docs, none):
    text = "é token = 'abcdef' PASSWORD:12345 aws AKIA" + "A1" * 8 + " sha " + "0af3" * 6 + " pwd: kJ8#mQz!p2Lx apikey=changeme"
    base = secrets.base_spans(text)
    assert [text[a:b] for a, b, k in base if k == "assign"] == ["token = 'abcdef", "apikey=changeme"]
    assert [k for *_, k in base].count("access") == [k for *_, k in base].count("hex") == 1
    assert [text[a:b] for a, b, _ in secrets.guessed_spans(text)] == ["kJ8#mQz!p2Lx"]
    assert secrets.guess_cost("changeme") < secrets.guess_cost("Summer2024") < secrets.guess_cost("kJ8#mQz!p2Lx")
    got = secrets.scan(docs).collect()
    assert len(got) == docs.count() and all(r.base_sha256 == sha("") for r in got) and secrets.scan(none).count() == 0


def test_secrets_context():
    found = lambda text: [text[a:b] for a, b, _ in secrets.guessed_spans(text)]
    assert found("password: k7@Qz!9mWp2 x") == found("'password': 'k7@Qz!9mWp2' x") == ["k7@Qz!9mWp2"]
    assert found("Authorization: Bearer eyJhbGciOiJIUzI1") == ["eyJhbGciOiJIUzI1"] and found("secret_key = kJ8#m,Qz;2Lx") == ["kJ8#m,Qz;2Lx"]
    assert found("redis://:k7Qz!9mWp2@host/0") == found("ftp://user:k7Qz!9mWp2@host") == ["k7Qz!9mWp2"]
    assert found("see http://localhost:8080/index.html and http://a.b:8080/x@y.html") == []


def test_secrets_leave_words_of_the_table(spark):
    texts = ["The password is incorrect.", "the secret is patience"] + ["patience is never incorrect here"] * 3 + ["password: kJ8#mQz!p2Lx"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = [r.text for r in secrets.redact(df).orderBy("doc_id").collect()]
    assert got == [*texts[:-1], "password: [secret]"] and [r.n_guess for r in secrets.scan(df).orderBy("doc_id").collect()] == [0] * 5 + [1]


def brute_cost(text):
    """Least cost over all segmentations, by recursion instead of the dynamic program."""
    import math

    cheap = list(secrets._segments(text))
    brute = math.log10(secrets._charset(text))

    def least(j):
        return 0.0 if j == 0 else min([least(j - 1) + brute, *(least(i) + c + 0.3 for i, e, c in cheap if e == j)])

    return least(len(text))


@pytest.mark.parametrize("value", ["password1", "qwerty99", "aaabbb", "20240101x", "p4ss!Zx"])
def test_guess_cost_against_recursion(value):
    assert secrets.guess_cost(value) == pytest.approx(brute_cost(value))


def test_mix(spark, docs, none):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got, again = (sorted(map(tuple, mixing.mix(table).collect())) for _ in range(2))
    assert got == again and len(got) == table.count() and all(r[4] <= 3 * r[1] for r in got)
    source = {r.doc_id: r.source for r in table.collect()}
    totals, goal, largest = {}, {}, {}
    for doc_id, size, _, target, taken in got:
        s = source[doc_id]
        totals[s], goal[s], largest[s] = totals.get(s, 0) + taken, target, max(largest.get(s, 0), size)
    assert sum(goal.values()) == pytest.approx(sum(r[1] for r in got))
    assert all(abs(totals[s] - goal[s]) <= largest[s] + 1 for s in goal)
    hard = mixing.mix(docs).collect()
    assert len(hard) == docs.count() and all(r.taken <= 3 * r.size for r in hard) and mixing.mix(none).count() == 0


def test_targets_and_flow():
    assert mixing.targets({"a": 10, "b": 100, None: 100}) == {"a": 30.0, "b": 120.0, None: 60.0}
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}
    # The overlap goes to the source that has nothing else; no words are repeated.
    taken = mixing.route({("a",): 50, ("a", "b"): 50}, {"a": 50, "b": 50})
    assert taken == {("a",): 50, ("a", "b"): 50}
    assert mixing.route({("a",): 10}, {"a": 25}) == {("a",): 25}


def test_language(spark, docs, none):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(table).join(table, "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    hard = langid.identify(docs).collect()
    assert all(0 <= r.score <= 1 for r in hard) and len(hard) == docs.count()
    assert {r.lang_pred for r in hard if r.doc_id in (0, 1, 2)} == {"und"} and langid.identify(none).count() == 0


def test_phrases_against_plain_parsing():
    rng = random.Random(2)
    taught = "".join(rng.choice("abc ") for _ in range(300))
    model = langid.Model({"x": taught, "y": taught[::-1].replace("a", "d")})
    for n in (1, 5, 256, 700):
        text = "".join(rng.choice("abcd ") for _ in range(n))
        points = langid.letters(text)
        clean = "".join(map(chr, points))
        want = {}
        for lang, sample in (("x", taught), ("y", taught[::-1].replace("a", "d"))):
            known, count = "".join(map(chr, langid.letters(sample))), 0
            for w in range(0, len(clean), langid.WINDOW):
                window, i = clean[w : w + langid.WINDOW], 0
                while i < len(window):
                    k = 1
                    while i + k < len(window) and window[i : i + k + 1] in known:
                        k += 1
                    count, i = count + 1, i + k
            want[lang] = count
        names, _ = langid.predict_batch([text], model)
        if len(set(want.values())) == 2 and clean.strip():
            assert names == [min(want, key=want.get)]


def test_toxicity(spark, docs, none):
    folder = "/root/testdata/sf0.1"
    table, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    got = toxicity.classify(table, labels).join(labels, "doc_id").where("held_out").collect()
    hits = [r for r in got if r.predicted]
    assert np.mean([r.toxic == 1 for r in hits]) > 0.9 and sum(r.toxic for r in hits) > 0.85 * sum(r.toxic for r in got)
    few = spark.createDataFrame([(1, None), (None, 1), (3, 1)], "doc_id bigint, toxic int")
    hard = toxicity.classify(docs, few).collect()
    assert len(hard) == docs.count() and all(0 <= r.score <= 1 for r in hard) and toxicity.classify(none, few).count() == 0


def test_fingerprints(spark, docs, none):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    for frame in (table, docs.where("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = sorted(frame.select("doc_id", "text").collect(), key=lambda r: -r.doc_id)
        got = {r.doc_id: r for r in fingerprint.fingerprints(frame).collect()}
        prints = {}
        for i, row in enumerate(rows):
            text, other = row.text or "", rows[(i + 1) % len(rows)].text or ""
            third = len(text) // 3
            assert got[row.doc_id].edited_sha256 == sha(text[: len(text) - third] + other[:third])
            assert got[row.doc_id].n_chars == len(text)
            assert prints.setdefault(text, got[row.doc_id].fingerprint) == got[row.doc_id].fingerprint
    assert fingerprint.fingerprints(docs).count() == docs.count() and fingerprint.fingerprints(none).count() == 0


def test_fingerprint_is_homomorphic(spark):
    df = spark.createDataFrame([("a one\nb two\nc three", "c three\na one\nb two", "a one\nb two", "c three")], "x string, y string, z string, w string")
    x, y, z, w = (fingerprint.vector(F.col(c)) for c in "xyzw")
    parts = [fingerprint.digest(v) for v in (x, y, fingerprint.add(z, w), z, fingerprint.subtract(x, w))]
    got = df.select(*(p.alias(f"p{i}") for i, p in enumerate(parts)), fingerprint.likeness(x, z).alias("near")).first()
    assert got.p0 == got.p1 == got.p2 and got.p3 == got.p4 and 0 < got.near < 1


def test_likeness_does_not_depend_on_length(spark):
    lines = [f"line {i} of a text" for i in range(1500)]
    near = ["\n".join(lines), "\n".join(lines[:1000] + [f"other {i}" for i in range(500)])]
    far = "\n".join(f"far {i}" for i in range(1500))
    repeats = ["\n".join(["again"] * n + lines[:20]) for n in (40, 41)]
    df = spark.createDataFrame([(*near, far, *repeats, "")], "a string, b string, c string, d string, e string, f string")
    v = {c: fingerprint.vector(F.col(c)) for c in df.columns}
    got = df.select(*(fingerprint.likeness(v[x], v[y]).alias(x + y) for x, y in ("aa", "ab", "ac", "de", "af", "ff"))).first()
    assert got.aa == got.ff == 1 and got.af == 0 and abs(got.ab - 2 / 3) < 0.2 and got.ac < 0.3 and 0.9 < got.de < 1


def test_stored_fingerprint_takes_pieces(spark):
    rows = [(1, "a one\nb two\nc three"), (2, "a one\nc three")]
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    stored = spark.createDataFrame([(got[1].lanes, "b two")], "lanes array<bigint>, piece string")
    less = stored.select(fingerprint.digest(fingerprint.subtract(F.col("lanes"), fingerprint.vector(F.col("piece")))).alias("d")).first()
    assert less.d == got[2].fingerprint and len(got[1].lanes) == fingerprint.LANES and all(got[1].lanes)


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(20, 8))
    rows = [(i, (base[i % 20] + rng.normal(size=8) * 0.08).tolist(), i % 3) for i in range(200)]
    rows += [(300, rows[0][1], 0), (301, None, 0), (302, [0.0] * 8, 0), (303, [float("nan")] + [1.0] * 7, 0), (304, rows[0][1], None), (305, [], 0), (306, [1.0, None], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, v string")
    ok = {i: (np.array(v, np.float32).astype(float), lab) for i, v, lab in rows if i <= 300}
    linked = [(a, b) for a in ok for b in ok if a < b and ok[a][1] == ok[b][1] and ok[a][0] @ ok[b][0] / np.linalg.norm(ok[a][0]) / np.linalg.norm(ok[b][0]) >= 0.98]
    want = brute_components([r[0] for r in rows], linked)
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    assert len(linked) > 20 and len(got) == len(rows)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_links == sum(i in pair for pair in linked) and got[i].kept == (want[i] == i) for i in got)
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_pages(spark):
    rows = [
        (1, "http://h.com/a/1", "<nav>Menu</nav><div>Top line</div><p>one  &amp;\n two<br>three</p><p>own</p><div>End</div>"),
        (2, "http://h.com/a/2", "<div>Top line</div><p>other</p><div>End</div>"),
        (3, "http://h.com/b", "<article><header><h1>T</h1></header><p>Top line</p><div class='comments'><p>no</p></div></article><aside>x</aside>"),
        (4, None, "<p>kept<script>if (a<b) '</p>'</script> &eacute;"), (5, "http://x.com/", None), (None, "http://h.com/a/3", "<p>Top line</p>"), (2, None, ""),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, lines string, n_chars bigint")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in pages.extract(df).collect()}
    assert len(got) == len(rows) and got[1, "http://h.com/a/1"][0] == "one & two three\nown" and got[2, "http://h.com/a/2"] == ("other", 5)
    assert got[3, "http://h.com/b"][0] == "T\nTop line" and got[4, None][0] == "kept é" and got[5, "http://x.com/"] == ("", 0)
    assert pages.extract(df.where("false")).count() == 0


def test_block_rules():
    text = lambda page: [t for t, own in pages.blocks(page)]
    assert text("<body class='has-sidebar'><p>a</p></body>") == ["a"]
    assert text("<main class='no-sidebar'><p>a</p></main>") == text("<article class='post has-comments'><p>a</p></article>") == ["a"]
    assert text("<main class='comments'>a</main><html class=search><body id=nav>b") == ["a", "b"]
    for page in ("<div class='comments'><div>x</div><article>no</article></div>", "<aside><article>no</article>x</aside>", "<nav><main>no</main></nav>"):
        assert pages.blocks(f"<article><p>a</p></article>{page}<p>b</p>") == [("a", True), ("b", False)]
    assert text("<div class='x comments-area'>no</div><nav><script>'</nav>'</script>no</nav><p class=ad>no<p>a") == ["a"]
    assert text("<head><title>no</title><body><p>a") == ["a"] and text("<div class=ad>no<article>a</article>") == ["a"]


def test_marked_articles_are_differenced(spark):
    """A template inside main goes where other pages of the host share it; copies of an article stay whole."""
    page = "<main><p>We use a notice here</p><p>%s</p><p>Read more on our site</p></main>"
    rows = [(i, f"http://t.com/n/{i}", page % (f"long text number {i} " * 9)) for i in range(4)]
    rows += [(10 + i, f"http://c.com/n/{i}", "<article><p>same words of one article</p><p>same end</p></article>") for i in range(2)]
    # One partner shares the short line by chance, the other does not.
    rows += [(20 + i, f"http://s.com/n/{i}", f"<article><p>{'Yes.' if i < 2 else 'No.'}</p><p>{f'own words {i} ' * 9}</p></article>") for i in range(3)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in pages.extract(df).collect()}
    assert all(got[i] == (f"long text number {i} " * 9).strip() for i in range(4))
    assert got[10] == got[11] == "same words of one article\nsame end"
    assert got[20].startswith("Yes.\n") and got[21].startswith("Yes.\n")


def test_common_lines_against_recursion():
    rng = random.Random(1)

    def length(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert len(pages.common_lines(a, b)) == length(a, b)


def test_token_counts(spark, docs, none):
    path = public_tokenizers.path(queries.UNIGRAM)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    whole = Tokenizer(models.Unigram([(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())], 0, True))
    vocabulary = tokencount.Vocabulary.read(path)
    for frame in (docs, spark.read.parquet(f"{SF}/documents.parquet")):
        texts = {(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()}
        got = {(r.doc_id, r.n_chars, r.n_tokens) for r in tokencount.token_counts(frame, vocabulary).collect()}
        want = {(i, len(t or ""), len(whole.encode("▁" + t.replace(" ", "▁")).ids) if t else 0) for i, t in texts}
        assert got == want
    assert tokencount.token_counts(none, vocabulary).count() == 0


def test_pipeline(spark, docs, none):
    for frame in (docs, none):
        kept = frame
        for name, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, SF)
            if name != "tokens":
                assert kept.columns == corpus_pipeline.COLUMNS
        kept.collect()
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_near_dedup_keeps_one_row_of_an_id(spark):
    words = "one two three four five six seven eight"
    rows = [(1, words, "en", "b", 1), (1, words, "en", "a", 1), (1, words, "en", "a", 1), (2, words, "en", "a", 1), (3, "other " + words[::-1], "en", "a", 1)]
    rows += [(3, "a text of its own with the same id", "en", "a", 1), (4, words, "en", "a", 1), (4, None, "en", "a", 1), (5, None, None, "a", 1), (5, None, None, "a", 1)]
    rows += [(None, words, "en", "a", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(map(tuple, corpus_pipeline.near_dedup(spark, df, SF).collect()), key=str)
    want = [rows[1], rows[5], rows[7], rows[8], rows[10], rows[11]]
    assert got == sorted(want, key=str)


def test_pipeline_redacts(spark):
    df = spark.createDataFrame([(1, "see token = abcdef0123 end", "en", "s", 26)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    row = corpus_pipeline.no_secrets(spark, df, SF).first()
    assert row.text == "see [secret] end" and row.n_chars == 16
