"""Each operator against brute force or exact round trips, and its edge cases."""

import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from talata.llm import components, decontaminate, langid, licenses, linefreq, packing, quality, simhash, surrogates, tokenfiles, urlgraph
from talata.llm.common import new_path, range_partitions
from talata.llm.wordbpe import WordBpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = "lorem ipsum dolor sit amet " * 9000
TEXTS = [None, "", "   ", "one", "The quick brown fox, isn't it? 42", "Ünïcode é ß İ ﬁ 漢字 é \x00\x1f", "<|endoftext|> inside", LONG, "one", "a\tb\nc\r\x0bd\x0ce", "Σίσυφος ΣΑΣ", "don't DON'T 's"]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and very long texts, repeated rows, a null id, and columns whose names operators use."""
    rows = [(i, t, "x", 1, "z") for i, t in enumerate(TEXTS)] + [(3, "one", "x", 1, "z"), (None, "no id here", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, task int, rank string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def encoded(text, end):
    return np.array([*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def test_encoding_equals_the_library():
    tokenizer, own = Tokenizer.from_file(PATH), WordBpe(PATH)
    assert own.plain
    rng = random.Random(1)
    alphabet = "abcxyzABCÉéßñ0123456789'stremvd!?.,#-  \n\t²½ªµ×÷\xa0\xad"
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    for t in texts:
        assert own.encode(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(t)


def brute_bins(items, capacity):
    best = [len(items)]

    def rec(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += items[i]
                rec(i + 1, bins)
                bins[k] -= items[i]
        rec(i + 1, [*bins, items[i]])

    rec(0, [])
    return best[0]


def test_packing_is_optimal_on_small_cases():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([10, 20, 50])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        plan = packing.pack_counts(collections.Counter(items), capacity)
        used = collections.Counter()
        for pattern, bins in plan:
            assert sum(x * c for x, c in pattern) <= capacity
            for x, c in pattern:
                used[x] += c * bins
        assert used == collections.Counter(items) and sum(m for _, m in plan) == brute_bins(items, capacity)
    assert packing.pack_counts({}, 10) == []


def test_packing_beyond_best_fit():
    """Lengths about a third and a quarter of a bin: the search starts, keeps every piece, is no worse than best fit, and says if it is proven."""
    rng = random.Random(11)
    better = 0
    for _ in range(4):
        counts = collections.Counter(rng.choice([rng.randint(1000, 1500), rng.randint(600, 1100)]) for _ in range(120))
        plan, proven = packing.solve(counts, 4096, 300)
        used = collections.Counter()
        for pattern, bins in plan:
            assert sum(x * c for x, c in pattern) <= 4096
            for x, c in pattern:
                used[x] += c * bins
        lengths = np.zeros(4097, dtype=np.int64)
        for x, c in counts.items():
            lengths[x] = c
        bins, first, floor = (sum(m for _, m in plan), sum(m for _, m in packing.best_fit_decreasing(counts, 4096)), packing.lower_bound(lengths, 4096))
        assert used == counts and floor <= bins <= first and (proven or bins > floor)
        better += bins < first
    assert better
    for _ in range(60):
        items = sorted((rng.randint(3, 20) for _ in range(rng.randint(2, 9))), reverse=True)
        plan, proven = packing.solve(collections.Counter(items), 20)
        assert proven and sum(m for _, m in plan) == brute_bins(items, 20)


def test_packing_documents(spark, docs, empty):
    made = packing.pack_documents(docs, PATH, with_ids=True).toPandas()
    assert sorted(made.doc_id.dropna()) and made.doc_id.isna().sum() == 1
    pieces = made.sort_values(["doc_id", "piece"])
    for i, t in enumerate(TEXTS):
        want = encoded(t, 1)
        own = pieces[pieces.doc_id == i].drop_duplicates("piece")
        assert np.concatenate(own.ids.tolist()).tolist() == want.tolist()
        assert own.ids_crc32.tolist() == [zlib.crc32(want[s : s + n].tobytes()) for s, n in zip(own.start, own.length, strict=True)]
    for _, bin_ in made.sort_values("offset").groupby("sequence_id"):
        assert bin_.offset.tolist() == [0, *np.cumsum(bin_.length)[:-1]] and bin_.length.sum() <= 4096
    assert packing.pack_documents(empty, PATH).count() == 0


def test_token_files_round_trip(spark, docs, empty):
    folder = new_path(spark, "test-ids")
    manifest = tokenfiles.write_token_files(docs, folder, PATH, file_bytes=200)
    rows = tokenfiles.read_token_files(manifest, folder, with_ids=True).orderBy("start").collect()
    order = [(i is not None, i) for i in (r.doc_id for r in rows)]
    assert order == sorted(order, key=lambda x: (x[0], x[1] or 0)) and len(rows) == len(TEXTS) + 2
    at = 0
    for r in rows:
        want = encoded("no id here" if r.doc_id is None else TEXTS[r.doc_id], 2)
        assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (at, len(want), zlib.crc32(want.tobytes()), want.tolist())
        at += len(want)
    assert tokenfiles.read_document(manifest, folder, 4).tolist() == encoded(TEXTS[4], 2).tolist()
    assert tokenfiles.read_document(manifest, folder, 999) is None
    assert [x.tolist() for x in tokenfiles.read_documents(manifest, folder, 3)] == [encoded("one", 2).tolist()] * 2
    none = new_path(spark, "test-ids")
    assert tokenfiles.read_token_files(tokenfiles.write_token_files(empty, none, PATH), none).count() == 0


def test_one_id_is_split_over_files(spark):
    """A third of the rows with one id and as many without: no task gets them all, and the order holds."""
    texts = ["same text", "another one", "x " * 50]
    rows = [(7, texts[i % 3]) for i in range(600)] + [(None, texts[i % 2]) for i in range(600)] + [(100 + i, "t") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    folder = new_path(spark, "test-ids")
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "12"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        manifest = tokenfiles.write_token_files(df, folder, PATH)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    files = manifest.orderBy("start").collect()
    assert len(files) >= 8 and max(f.n_docs for f in files) <= 450
    ids = [r.doc_id for r in tokenfiles.read_token_files(manifest, folder).orderBy("start").collect()]
    assert ids == [None] * 600 + [7] * 600 + list(range(100, 700))
    assert len(tokenfiles.read_documents(manifest, folder, 7)) == 600


def test_shared_dictionary_is_used(spark, data):
    folder = new_path(spark, "test-ids")
    some = spark.read.parquet(f"{data}/documents.parquet")
    manifest = tokenfiles.write_token_files(some, folder, PATH)
    path = manifest.first().path
    head = open(path, "rb").read(44)
    assert head[:8] == tokenfiles.MAGIC and any(head[8:40])
    assert manifest.agg(F.sum("n_docs")).first()[0] == some.count()


def slow_print(text):
    import xxhash

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components_equal_brute_force(spark, docs, empty, data):
    some = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").toPandas()
    made = simhash.simhash_components(spark.createDataFrame(some)).toPandas().set_index("doc_id").loc[some.doc_id]
    prints = np.array([slow_print(t) for t in some.text], dtype=np.uint64)
    assert made.fingerprint.tolist() == [f"{p:016x}" for p in prints]
    root = some.doc_id.tolist()
    changed = True
    while changed:
        changed = False
        for i in range(len(root)):
            near = np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3)
            least = min(root[j] for j in near)
            changed |= least < root[i]
            root[i] = least
    assert made.component_id.tolist() == root
    edge = simhash.simhash_components(docs).collect()
    assert len(edge) == len(TEXTS) + 2 and {r.component_id for r in edge if r.doc_id in (0, 1, 2)} == {0}
    assert simhash.simhash_components(empty).count() == 0


@pytest.mark.parametrize("most", [1000, 8])
def test_near_links_connect_all_links(spark, most):
    """With a small shard limit, all three levels of sharding run."""
    rng = random.Random(5)
    values = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        values |= {base} | {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(25)}
    values = sorted(values)
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    edges = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "print long"), most=most)
    roots = {r.node: r.root for r in components.connected_components(edges).collect()}
    parent = {v: v for v in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 3:
                x, y = find(signed[i]), find(signed[j])
                parent[max(x, y)] = min(x, y)
    assert {v: find(v) for v in signed} == {v: roots.get(v, v) for v in signed}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3), (60, 50), (55, 60)]
    made = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert made == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 50: 50, 55: 50, 60: 50}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one(spark):
    rows = [(1, "a b c d"), (2, "a b c d"), (3, "other words stand here"), (3, "other words stand here"), (None, "a b c d"), (None, "alone without any id"), (4, None), (5, "")]
    made = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").withColumn("stays", F.lit(1)))
    assert made.columns == ["doc_id", "text", "stays"]
    assert sorted((r.doc_id or 0, r.text or "") for r in made.collect()) == [(0, "alone without any id"), (1, "a b c d"), (3, "other words stand here"), (4, "")]


def test_language(spark, docs, empty, data):
    all_ = spark.read.parquet(f"{data}/documents.parquet")
    learned = langid.learn(langid.learnable(all_))
    assert set(learned) == {"de", "en", "es", "fr"}
    held = langid.identify(all_.select("doc_id", "text", "lang").where(langid.held_out(4, 2)), learned).toPandas()
    assert (held.lang_pred == held.lang).mean() >= 0.9
    made = langid.identify(docs, learned)
    rows = {r.doc_id: r for r in made.collect()}
    assert rows[0].lang_pred == rows[1].lang_pred == rows[2].lang_pred == "und" and rows[4].lang_pred != "und" and 0 <= rows[4].score <= 1
    assert made.count() == docs.count() and langid.identify(empty, learned).count() == 0
    assert langid.learn(empty.withColumn("lang", F.lit("x"))) == {} and {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}
    clash = langid.identify(docs.withColumns({"score": F.lit("x"), "Margin": F.lit(1)}), learned)
    assert clash.columns == [*docs.columns, "lang_pred", "score", "margin"] and dict(clash.dtypes)["score"] == "double"
    dirty = all_.select("doc_id", "text", F.concat(F.lit("l"), (F.col("doc_id") % 30).cast("string")).alias("lang"))
    assert len(langid.learn(dirty)) >= 4 and len(langid.learn(all_.unionAll(all_).withColumn("doc_id", F.lit(1)))) == 4
    kept = langid.accepted(docs, learned)
    assert kept.columns == docs.columns and kept.where("text IS NULL OR trim(text) = ''").count() == 0


def test_quality(spark, docs, empty):
    rng = random.Random(2)
    good = lambda: " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7))) for _ in range(40))
    rows = [(i, good() if i % 3 else " ".join(w + "!!" for w in good().split()), int(i % 3 > 0)) for i in range(300)]
    all_ = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    learned = quality.train(quality.sample(all_, all_.select("doc_id", "quality").where(~langid.held_out(5, 0)), "quality"))
    made = quality.score(all_, learned).join(all_, "doc_id").where(langid.held_out(5, 0)).toPandas()
    assert ((made.score >= 0.3) == (made.quality == 1)).mean() >= 0.95
    edge = quality.score(docs, learned).toPandas()
    assert len(edge) == len(TEXTS) + 2 and edge.score.between(0, 1).all() and quality.score(empty, learned).count() == 0
    bias = edge[edge.doc_id.isin([0, 1, 2])].score
    assert bias.nunique() == 1 and math.isfinite(bias.iloc[0])
    again = quality.sample(all_.unionAll(all_), all_.select("doc_id", "quality").unionAll(all_.select("doc_id", F.lit(0))), "quality", most=50)
    assert len(again) == 50 and len({t for t, _ in again}) == 50 and again == quality.sample(all_.repartition(5), all_.select("doc_id", "quality"), "quality", most=50)
    few = quality.sample(all_, all_.select("doc_id", "quality"), "quality", chars=1000)
    assert 1 <= len(few) < 10 and {t for t, _ in few} <= {r[1] for r in rows} and sum(len(t) for t, _ in few) <= 1000
    untrained = quality.train([])
    assert set(quality.score(docs, untrained).toPandas().score) == {0.5}


def test_ftrl_equals_brute_force():
    """The vectorised updates against the published rule, one coordinate at a time in plain floats."""
    rng = random.Random(8)
    rows = [({rng.randrange(30): rng.uniform(0.1, 2) for _ in range(rng.randint(1, 8))}, rng.randint(0, 1)) for _ in range(200)]
    a, b, l1, l2 = quality.ALPHA, quality.BETA, quality.L1, quality.L2
    z, n = collections.Counter(), collections.Counter()
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((b + math.sqrt(n[i])) / a + l2)
    model = quality.Ftrl()
    for x, y in rows:
        w = {i: weight(i) for i in x}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
        for i, v in x.items():
            g = (p - y) * v
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / a
            z[i] += g - sigma * w[i]
            n[i] += g * g
        model.update(np.array(list(x)), np.array(list(x.values())), y)
    made = model.weights()
    assert all(abs(made[i] - weight(i)) < 1e-9 for i in range(30)) and any(weight(i) for i in range(30)) and not made[30:].any()


def test_held_out_quality(spark, data):
    """Accuracy on documents that nothing was learned from, against always saying the commoner label."""
    sf = data.replace("0.001", "0.01")
    made = quality.op2_quality_ftrl(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").where("quality IS NOT NULL"), "doc_id").toPandas()
    accuracy = (made.predicted == made.quality).mean()
    assert len(made) > 40 and accuracy >= 0.95 and accuracy > max(made.quality.mean(), 1 - made.quality.mean())


def test_text_counts(spark, docs):
    words = [f"w{i % 9}" for i in range(40)]
    texts = [*TEXTS, " ".join(words), "a b\n\na b\n  \na  b\nx", "### $& ok"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    made = {r.doc_id: r for r in linefreq.text_counts(df).collect()}
    clash = linefreq.text_counts(df.withColumns({c: F.lit("own") for c in ("hashes", "lines", "windows", "doc", "t", "N_words", "starts")}))
    assert sorted(map(str, clash.select("doc_id", *linefreq.COUNTS).collect())) == sorted(map(str, linefreq.text_counts(df).select("doc_id", *linefreq.COUNTS).collect())) and {r.t for r in clash.collect()} == {"own"}
    for i, t in enumerate(texts):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        repeated = {k for j in range(len(w) - 7) if seen[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
        r = made[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(repeated)), i


def test_frequent_lines(spark, docs, empty):
    body = lambda i: "\n".join(f"line {i} number {k} has its own words" for k in range(4))
    shared = "shared line of the site " + " ".join(f"s{k}" for k in range(30))
    rows = [(i, f"{shared.upper()}  \n{body(i)}", "h") for i in range(30)] + [(100 + i, f"{shared}\nown", "h") for i in range(3)] + [(200, f"{shared}\n{body(200)}", None)]
    made = {r.doc_id: r for r in linefreq.filter_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), with_text=True).collect()}
    assert all(made[i].kept and made[i].removed_lines == 1 and made[i].text == body(i) for i in range(30))
    assert not any(made[100 + i].kept or made[100 + i].base_failed for i in range(3)) and made[101].text == "own"
    assert made[200].removed_lines == 0 and made[200].kept
    edge = linefreq.filter_lines(docs)
    assert edge.count() == docs.count() and edge.where("text IS NULL" if "text" in edge.columns else "n_words = 0").where("kept").count() == 0
    assert linefreq.filter_lines(empty).count() == 0


def test_line_limits_equal_sql(spark, data):
    """Lines of repeated and null ids count once a document; the limits of large and small hosts; equal to the query's SQL."""
    import duckdb

    body = lambda i: "\n".join(f"line {i} number {k} has its own words" for k in range(5))
    rows = [(1 + i % 2, f"twice said line\n{body(1 + i % 2)}", "rows") for i in range(15)] + [(None, f"line without an id\n{body(7)}", "rows")] * 9
    rows += [(100 + i, f"in twenty one\n{'in twenty' if i else 'other'}\n{body(100 + i)}", "large") for i in range(21)] + [(200 + i, body(200 + i), "large") for i in range(900)]
    rows += [(2000 + i, f"{'in four' if i < 4 else 'x'}\n{'in three' if i < 3 else 'y'}\n{body(2000 + i)}", "small") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    made = linefreq.filter_lines(df)
    documents = df.toPandas()
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.execute(linefreq.OP3_SQL.replace("coalesce(doc_id, -1)", "coalesce(doc_id::BIGINT, -1)")).df()
    got = made.toPandas()[want.columns]
    key = ["doc_id", "n_words", "removed_lines"]
    assert got.sort_values(key).astype(str).values.tolist() == want.sort_values(key).astype(str).values.tolist()
    lost = {r.doc_id: r.removed_lines for r in made.collect()}
    assert lost[1] == lost[2] == lost[None] == 0 and lost[100] == lost[120] == 1 and lost[2000] == 1 and lost[2003] == lost[2004] == 2


KEY = surrogates.TEST_KEY


def test_surrogates(spark, docs, empty):
    texts = [
        "Mail anna.b@mail3.example.com or ANNA.B@MAIL3.EXAMPLE.COM, call +1 (744) 555-2801.",
        "Again anna.b@mail3.example.com and 1-744-555-2801 from 87.229.221.26, card 4539 1488 0343 6467.",
        'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" password=45bb0d53635bf1b89d',
        "Mr. John Smith met Mrs. Jane Smith and Frau Müller; Господин Иван Петров came. SSN 123-45-6789",
        "A clean text, version 2.0 of 2024, page 12.",
    ]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, doc string")
    made = {r.doc_id: r for r in surrogates.replace_entities(df, KEY, details=True).collect()}
    again = {r.doc_id: r.text for r in surrogates.replace_entities(df.repartition(3), KEY).collect()}
    assert {i: r.text for i, r in made.items()} == again and made[4].text == texts[4] and made[0].doc == "k"
    for secret in ("anna.b", "744", "87.229", "1488", "24be64", "45bb0d", "John", "Jane", "Müller", "Петров", "123-45"):
        assert not any(secret.lower() in r.text.lower() for r in made.values()), secret
    mail = re.findall(r"[\w.]+@[\w.]+\.com", made[0].text, re.IGNORECASE)
    assert mail[1] == mail[0].upper() and mail[0] in made[1].text
    phone = re.search(r"\+1 \(\d{3}\) 555-\d{4}", made[0].text)[0]
    card = re.search(r"4\d{3} \d{4} \d{4} \d{4}", made[1].text)[0].replace(" ", "")
    assert phone and luhn(card)
    assert re.search(r'token = "[0-9a-f]{40}" password=[0-9a-f]{18}$', made[2].text)
    names = re.findall(r"(?:Mr\.|Mrs\.|Frau) \w+(?: \w+)?", made[3].text)
    assert names[0].split()[1] in surrogates.GIVEN["latin-m"] and names[1].split()[1] in surrogates.GIVEN["latin-f"] and names[0].split()[2] == names[1].split()[2]
    assert re.search(r"Господин [А-я]+ [А-я]+", made[3].text)
    other = {r.doc_id: r.text for r in surrogates.replace_entities(df, "another key").collect()}
    assert other[0] != made[0].text
    edge = surrogates.replace_entities(docs, KEY)
    assert edge.columns == docs.columns and sorted(map(str, edge.collect())) == sorted(map(str, docs.collect()))
    assert surrogates.replace_entities(empty, KEY).count() == 0


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def replaced(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in surrogates.replace_entities(df, KEY).orderBy("doc_id").collect()]


def test_surrogates_of_awkward_texts(spark):
    """Secrets and addresses without letters, one number in two formats, hyphens, untitled and short mentions, false cards."""
    blank = "password: ______________ (fill in)"
    made = replaced(
        spark,
        blank,
        "write to __@odd.example.com or --@odd.example.com or " + " ".join(f"{c}@one.example.com" for c in "abcdefghijklmnopqrstuvwxyz0123456789"),
        "744-555-2801 is +1 (744) 555-2801 and (744) 555-2801; not 744-555-2802",
        "Mrs. Ann Smith-Jones came. Later Ann Smith-Jones left.",
        "Mr. John Smith wrote. John Smith agreed, and Smith paid. Smithson did not. Mr. Smith, MR SMITH or Mr. SMITH?",
        "order 9807915762804491 and 1234567890123456, IBAN DE00 3704 0044 0532 0130 00",
        "IBAN DE89 3704 0044 0532 0130 00 and fe80::1ff:fe23:4567:890a at 12:30:45 in std::string add::bad",
        "Dr. Maria Rossi and Mr. J. R. Ewing, then J. R. Ewing",
        'secret = "___________________a"',
    )
    assert made[0] == blank
    mails = re.findall(r"\S+@\S+", made[1])
    assert len(mails) == len(set(mails)) == 38 and not re.search(r"(?:odd|one)\.example", made[1])
    digits = [re.sub(r"\D", "", x)[-10:] for x in re.findall(r"[+(]?\d[\d ()-]+\d", made[2])]
    assert len(set(digits[:3])) == 1 and digits[3] != digits[0] and not any(d.startswith("744") for d in digits)
    names = re.findall(r"(?:Mrs\.|Later) ([A-Z]\w+ [A-Z]\w+)", made[3])
    assert names[0] == names[1] and not re.search("Ann|Smith|Jones", made[3])
    given, family = re.match(r"Mr\. (\w+) (\w+) wrote", made[4]).groups()
    assert made[4] == f"Mr. {given} {family} wrote. {given} {family} agreed, and {family} paid. Smithson did not. Mr. {family}, MR {family.upper()} or Mr. {family.upper()}?"
    assert made[5] == "order 9807915762804491 and 1234567890123456, IBAN DE00 3704 0044 0532 0130 00"
    iban = re.search(r"DE\d\d(?: \w{4}){4} \w\w", made[6])[0].replace(" ", "")
    assert iban != "DE89370400440532013000" and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert "fe80" not in made[6] and made[6].endswith(" at 12:30:45 in std::string add::bad")
    assert not re.search("Maria|Rossi|Ewing", made[7]) and len(set(re.findall(r"[A-Z]\. \w+|[A-Z]\. [A-Z]\. \w+", made[7][made[7].index("Mr.") + 4 :]))) == 1
    assert made[8] != 'secret = "___________________a"'


def test_surrogates_leave_no_entity(spark, data):
    """Against an own search of the test documents: every entity gone, one surrogate each, all distinct, all else as it was."""
    rows = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    before = {r.doc_id: r.text for r in rows.where("text IS NOT NULL").collect()}
    after = {r.doc_id: r.text for r in surrogates.replace_entities(rows, KEY).where("text IS NOT NULL").collect()}
    assert before.keys() == after.keys()
    mark = re.compile(r"[\w.]+@[\w.]+\.[a-z]{2,}|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])|(?<=token = \")\w+|(?<=password=)\w+|(?<!\d)\d{16}(?!\d)")
    pairs = set()
    for i, text in before.items():
        old, new = mark.findall(text), mark.findall(after[i])
        assert mark.split(text) == mark.split(after[i])
        pairs |= {(a, b) for a, b in zip(old, new, strict=True) if not re.fullmatch(r"\d{16}", a) or luhn(a) or a != b}
    originals, made = {a for a, _ in pairs}, {b for _, b in pairs}
    assert len(originals) > 50 and len(pairs) == len(originals) == len(made) and not originals & made
    assert all(luhn(a) and luhn(b) for a, b in pairs if re.fullmatch(r"\d{16}", a))


def test_surrogates_are_distinct(spark):
    """Few given names and small spaces force clashes; they are resolved and no surrogate is a real entity."""
    rows = [("phone", f"1212555{i:04d}") for i in range(3000)] + [("given", f"latin-m:{chr(65 + i % 26)}x{i // 26}") for i in range(100)]
    rows += [("phone", f"+{10000 + i}") for i in range(1000)] + [("given", f"latin-f:{c}.") for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"] + [("given", "latin-m:Adam"), ("family", "latin:bruno")]
    made = surrogates.assign(spark.createDataFrame(sorted(set(rows)), "kind string, canon string"), KEY).toPandas()
    assert len(made) == len(set(rows))
    phones = made[made.kind == "phone"]
    assert phones.made.is_unique and not set(phones.made) & set(phones.canon)
    names = made[made.kind != "phone"]
    assert names.made.str.lower().is_unique and not set(names.made.str.lower()) & set(names.canon.str.split(":").str[-1].str.lower())


def test_surrogates_leave_small_spaces(spark):
    """Later attempts of every type leave the small space of the first ones, and grow."""
    rows = [("phone", "12025550123"), ("ip", "8.8.8.8"), ("given", "latin-f:Ann"), ("given", "greek-m:Άρης"), ("secret", "___________a"), ("email", "a@b.de"), ("ip6", "1::2:3"), ("family", "latin:smith"), ("card", "4539148803436467"), ("ssn", "123456789"), ("iban", "DE89370400440532013000")]
    tried = spark.createDataFrame(rows, "kind string, canon string").crossJoin(spark.range(40).select(F.col("id").cast("int").alias("attempt")))
    made = tried.select("kind", "canon", "attempt", surrogates.surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), KEY).alias("made")).toPandas()
    assert made.made.notna().all()
    assert all(bool(re.fullmatch(r"1[2-9]\d\d555\d{4,}", m)) == (a < 3 or m[4:7] == "555") and re.fullmatch(r"1[2-9]\d\d[2-9]\d{6,}", m) for k, _, a, m in made.values if k == "phone")
    assert all(m.startswith("10.") if a < 3 else 240 <= int(m.split(".")[0]) < 255 if a < 8 else re.fullmatch(surrogates._IP6, m) for k, _, a, m in made.values if k == "ip")
    for _, own in made[made.attempt >= 9].groupby(["kind", "canon"]):
        assert own.made.nunique() == len(own)


def test_range_partitions(spark, data, empty):
    documents = spark.read.parquet(f"{data}/documents.parquet")
    assert range_partitions(documents) == int(spark.conf.get("spark.sql.shuffle.partitions")) == range_partitions(empty)
    assert range_partitions(documents, bytes_each=10_000) > 20


def test_decontamination(spark, docs, empty):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [say(n) for n in (3, 5, 12, 30, 60, 200)] + [[]]
    texts = []
    for i, item in enumerate(items):
        for cut in (0, 1, len(item) // 8, len(item) // 4, len(item) // 2):
            texts.append((i, " ".join(say(900)) + " " + ", ".join(item[cut:]).upper() + ". " + " ".join(say(300))))
    texts += [(99, None), (99, ""), (None, " ".join(items[3])), (7, "only four words here")]
    d = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string").unionAll(spark.createDataFrame([(None, " ".join(items[3]))], "doc_id long, text string"))
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(50, None)], "item_id long, text string")

    def shingles(words, n):
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}

    want = set()
    for k, (_, t) in enumerate(texts):
        words = re.findall(r"\w+", (t or "").lower())
        for i, item in enumerate(items):
            if item:
                own = shingles(item, min(5, len(item)))
                if len(own & shingles(words, min(5, len(item)))) / len(own) >= 0.8:
                    want.add((k, i))
    made = decontaminate.contaminated(d, it).collect()
    assert {(r.doc_id, r.item_id) for r in made if r.doc_id is not None} == want and any(r.doc_id is None for r in made)
    kept = decontaminate.clean_documents(d.withColumn("key", F.lit(1)), it)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {k for k, _ in want} and kept.columns == ["doc_id", "text", "key"]
    assert decontaminate.contaminated(docs, it.limit(0)).count() == 0 and decontaminate.contaminated(empty, it).count() == 0
    twice = {(r.doc_id, r.item_id, r.containment) for r in decontaminate.contaminated(d.unionAll(d), it.unionAll(it)).collect()}
    assert twice == {(r.doc_id, r.item_id, r.containment) for r in made}
    named = it.limit(0).select(F.col("item_id").cast("string"), "text")
    assert dict(decontaminate.contaminated(docs, named).dtypes)["item_id"] == "string"
    long = spark.createDataFrame([(1, LONG + " ".join(items[2]) + " " + LONG), (1, " ".join(items[3][:15])), (2, LONG)], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(long, it).collect()] == [(1, 2)]


def test_decontamination_of_repeated_rows_equals_sql(spark, data):
    """Every row of both tables twice: the query's SQL over the doubled tables gives the same pairs."""
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE TABLE {table} AS SELECT * FROM '{data}/{table}.parquet' UNION ALL SELECT * FROM '{data}/{table}.parquet'")
    want = {tuple(r) for r in con.execute(decontaminate.OP8_SQL).fetchall()}
    docs, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    made = decontaminate.contaminated(docs.unionAll(docs), items.unionAll(items))
    assert {(r.doc_id, r.item_id, round(r.containment, 6)) for r in made.collect()} == want and want


def test_licenses(spark, docs, empty):
    rules = licenses.build_rules()
    assert len(rules) > 200 and all(r.keywords for r in rules)
    cases = {
        "Licensed under the Apache License, Version 2.0.": ({"apache-2.0"}, "apache"),
        "This work is licensed under the GNU General Public License, version 3.": ({"gpl-3.0"}, "gpl"),
        "gnu general public license version 2 or any later version": ({"gpl-2.0-or-later"}, "gpl"),
        "Released under the MIT License.": ({"mit"}, "mit"),
        "Licensed under CC BY-NC 4.0.": ({"cc-by-nc-4.0"}, "cc-by"),
        "SPDX-License-Identifier: BSD-3-Clause": ({"bsd-3-clause"}, ""),
        "https://creativecommons.org/licenses/by-sa/4.0/": ({"cc-by-sa-4.0"}, ""),
        "nothing of the kind": (set(), ""),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    made = {r.doc_id: r for r in licenses.scan_licenses(df, spans=True).collect()}
    for i, (labels, base) in enumerate(cases.values()):
        assert {d.label for d in made[i].detections} == labels and made[i].base_labels == base
        assert set(made[i].labels.split(",")) - {""} == labels | ({base} - {""})
        spans = [(d.start, d.end) for d in made[i].detections]
        assert not any(a != b and a[0] <= b[0] and b[1] <= a[1] for a in spans for b in spans)
    edge = licenses.scan_licenses(docs).collect()
    assert len(edge) == len(TEXTS) + 2 and all(0 <= r.score <= 1 for r in edge) and licenses.scan_licenses(empty).count() == 0
    again = licenses.scan_licenses(spark.createDataFrame([(1, "MIT license, the mit\nlicense! mit licenses cc-by")], "doc_id long, text string")).first()
    assert (again.n_words, again.n_base, again.first_word, again.last_word, again.base_labels) == (9, 3, 0, 7, "cc-by,mit")


@pytest.mark.parametrize("hub", [urlgraph.HUB, 2])
def test_pagerank_equals_the_fixed_point(spark, hub):
    """Against the solution of the linear system, with hosts whole and split."""
    rng = random.Random(6)
    edges = {(f"h{rng.randrange(12)}", f"h{rng.randrange(12)}") for _ in range(30)}
    edges = {(a, b): rng.randint(1, 4) for a, b in edges if a != b}
    seeds = {"h0": 2.0, "h5": 1.0, "lone": 1.0}
    hosts = sorted({x for e in edges for x in e} | set(seeds))
    at = {h: i for i, h in enumerate(hosts)}
    seed = np.array([seeds.get(h, 0) / 4 for h in hosts])
    flow = np.zeros((len(hosts), len(hosts)))
    for (a, b), n in edges.items():
        flow[at[b], at[a]] = n
    out = flow.sum(axis=0)
    flow = np.where(out > 0, flow / np.maximum(out, 1), seed[:, None])  # mass without a way out returns to the seeds
    want = np.linalg.solve(np.eye(len(hosts)) - 0.85 * flow, 0.15 * seed)
    made = urlgraph.pagerank(spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long"), spark.createDataFrame(list(seeds.items()), "host string, weight double"), hub=hub)
    got = {r.host: r.rank for r in made.collect()}
    assert got.keys() == set(hosts) and abs(sum(got.values()) - 1) < 1e-9
    assert max(abs(got[h] - want[at[h]]) for h in hosts) < 1e-4


def test_urls(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">l</a>' for h in hosts)
    rows = [
        (1, "https://A.Example.NET/en/1?q#f", link("friend.example.org")), (2, "http://b.example.net/fr/", None), (3, "https://bad.example.com/de/1", None), (4, "https://linker.example.com/en/1", link("bad.example.com")),
        (5, "https://friend.example.org/en/", None), (6, "https://x.example.org/fr/1", None), (7, None, ""), (8, "no scheme", ""), (9, "http://host.net", ""), (10, "ftp://plain.example.com?x", ""),
    ]
    made = {r.page_id: r for r in urlgraph.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()}
    assert [(r.host, r.path, r.rule, r.verdict) for r in map(made.get, (1, 2, 3, 6, 7, 9, 10))] == [
        ("a.example.net", "/en/1", "example.net/en/", "allow"), ("b.example.net", "/fr/", "net/", "block"), ("bad.example.com", "/de/1", "example.com/de/", "block"),
        ("x.example.org", "/fr/1", "org/fr/", "allow"), ("", "", None, "allow"), ("host.net", "", None, "allow"), ("plain.example.com", "", None, "allow"),
    ]
    assert made[4].verdict == "block" and made[5].verdict == "allow" and made[5].trust > 0 and made[4].distrust > 0
    assert urlgraph.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    twice = urlgraph.judge_urls(spark.createDataFrame([(1, rows[3][1], rows[3][2] + " " * 300_000)] * 2 + [(None, rows[3][1], None)] + rows[2:3], "page_id long, url string, html string"), [("example.com/de/", "block"), ("d.example.com/", "block")])
    assert sorted((r.page_id or 0, r.verdict) for r in twice.collect()) == [(0, "block"), (1, "block"), (1, "block"), (3, "block")]
    ties = spark.createDataFrame([(1, "http://a.b/c", None)], "page_id long, url string, html string")
    assert urlgraph.judge_urls(ties, [("a.b/", "allow"), ("b/c/", "block"), ("b/c", "block")]).first().rule == "a.b/"
