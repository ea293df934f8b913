"""Language ID, quality rules and sanitisation: held-out accuracy and brute force."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from astrolith.llm import language as L
from astrolith.llm import quality as Q
from astrolith.llm import sanitise as P
from astrolith.llm import text as T

DATA = "/root/testdata/sf0.01"


def test_language_on_held_out_rows(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").collect()
    fit, rest = rows[::2], rows[1::2]
    model = L.fit([r.text for r in fit], [r.lang for r in fit])
    labels, _, rejected = model.classify(pa.array([r.text for r in rest]))
    kept = [(a, r.lang) for a, r, bad in zip(labels, rest, rejected, strict=True) if not bad]
    assert len(kept) >= 0.97 * len(rest) and sum(a == b for a, b in kept) >= 0.95 * len(kept)
    junk, _, bad = model.classify(pa.array(["Ωμέγα και άλφα " * 9, "12345 !!!", "", None, "привет мир " * 9]))
    assert junk == [None] * 5 and bad.all()
    assert sum(len(set(np.flatnonzero(model.of == k))) for k in range(len(model.languages))) == 4 * L.CENTROIDS


def test_language_edges(spark):
    rows = [(1, "the cat and the dog are in the house", "en"), (2, "le chat et le chien sont dans la maison", "fr"), (3, None, "en"), (4, "", None), (None, "the dog and the cat", "en"), (1, "the cat and the dog are in the house", "en"), (5, "the house " * 60_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"language": F.lit("x"), "sample_id": F.lit(1), "h": F.lit(2)})
    got = L.identify(docs).collect()
    assert len(got) == 7 and {r.doc_id: r.language for r in got} == {1: "en", 2: "fr", 3: None, 4: None, None: "en", 5: "en"}
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == 5
    assert L.identify(docs.where("false")).count() == 0
    assert all(r.rejected for r in L.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect())


def test_rare_language_is_fitted_at_any_size(spark):
    rows = [(i, f"the cat number {i}", "en") for i in range(900)] + [(900 + i, f"le chat {i}", "fr") for i in range(80)] + [(980 + i, f"il gatto {i}", "it") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, labels = L.sample(docs, 40, "text", "lang", "doc_id")
    assert len(texts) == 40 and {k: labels.count(k) for k in set(labels)} in ({"en": 19, "fr": 18, "it": 3}, {"en": 18, "fr": 19, "it": 3})
    assert (texts, labels) == L.sample(docs.orderBy(F.desc("doc_id")), 40, "text", "lang", "doc_id")
    assert len(L.sample(docs, 2000, "text", "lang", "doc_id")[0]) == len(rows)


def plain_ngrams(text, dimensions):
    """Counts of n-grams by loops: words in lower case, other signs as spaces, none over a gap of two."""
    out = Counter()
    low = [(T.lowered()[ord(c)] if T.classes()[ord(c)] == T.LETTER else 32, T.classes()[ord(c)] == T.LETTER) for c in text]
    for n in (1, 2, 3):
        for k in range(len(low) - n + 1):
            if any(letter for _, letter in low[k : k + n]):
                h = 0
                for c, _ in low[k : k + n]:
                    h = (h * 0x100000001B3 + int(c)) % (1 << 64)
                out[int(T.mix(np.array([(h + (n << 56)) % (1 << 64)], np.uint64))[0]) % dimensions] += 1
    return out


def test_language_same_as_brute_force(spark):
    """The query's rows against dictionaries of n-grams and a cosine with each centroid."""
    rows = [("the cat and the dog are in the house by the river", "en"), ("a bird sings in the old tree of the garden", "en"), ("le chat et le chien sont dans la maison", "fr"), ("un oiseau chante dans le vieux jardin", "fr"), ("12 !!", None), ("the", None), ("le la les, the", None), ("Ωμέγα", None)] * 2
    docs = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(rows)], "doc_id long, text string, lang string")
    model = L.fit(*L.sample(docs, L.FIT_ROWS, "text", "lang", "doc_id"))
    for r in L.identify(docs).collect():
        counts = plain_ngrams(rows[r.doc_id][0], L.DIMENSIONS)
        v = {d: math.log1p(n) * float(model.idf[d]) for d, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        cosines = [sum(x * float(c[d]) for d, x in v.items()) / norm for c in model.centroids]
        best = int(np.argmax(np.round(cosines, 6)))
        total = sum(counts.values())
        bad = not total or cosines[best] < model.floor[min(11, int(math.log2(max(total, 1))))]
        assert r.rejected == bad and r.language == (None if bad else model.languages[model.of[best]]) and abs(r.cosine - max(cosines)) < 1e-5


def test_language_tie_goes_to_the_first_of_the_alphabet(spark):
    docs = spark.createDataFrame([(1, "the same words", "zz"), (2, "the same words", "aa"), (3, "the same words", None)], "doc_id long, text string, lang string")
    assert {r.language for r in L.identify(docs).collect()} == {"aa"}


def plain_statistics(t):
    words, lines, n = t.split(), [x for x in t.split("\n") if x.strip(" ")], max(1, len(t))
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w]
    share = lambda pattern: len(regex.findall(pattern, t)) / n
    return {
        "log_chars": math.log1p(len(t)), "word_length": len(t) / max(1, len(words)), "distinct_words": len(set(words)) / max(1, len(words)), "distinct_lines": len(set(lines)) / max(1, len(lines)),
        "line_length": math.log1p(len(t) / max(1, len(lines))), "upper": share(r"\p{Lu}"), "letters": share(r"\p{L}"), "digits": share(r"\p{N}"), "stops": share(r"[.!?]"), "commas": share(r"[,;:]"),
        "signs": share(r"[^ \t\n\x0b\f\r\p{L}\p{N}.!?,;:'\"()-]"), "doubled": share(r"([^ \t\n\x0b\f\r\p{L}\p{N}])\1"), "bars": share(r"[|\t]"),
    }


def test_quality_same_as_brute_force(spark):
    """The query over a table: rules that are tried one by one on plainly counted statistics."""
    data = f"{DATA}"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.fit(*Q.sample(docs, labels, Q.FIT_ROWS, "doc_id", "text", "quality"))
    got = {r.doc_id: (r.score, r.good) for r in Q.query(spark, data).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and model.rules
    for r in rows:
        stats = plain_statistics(r.text or "")
        z = model.intercept + sum(w for rule, w in zip(model.rules, model.weights, strict=True) if all((stats[name] <= cut) == most for name, most, cut in rule))
        score = 1 / (1 + math.exp(-z))
        assert abs(got[r.doc_id][0] - score) < 1e-9 and got[r.doc_id][1] == (got[r.doc_id][0] >= 0.5)


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    x, y, names = Q.sample(docs, labels, 100_000, "doc_id", "text", "quality")
    r = np.random.default_rng(0).random(len(y)) < 0.5
    model = Q.fit(x[r], y[r], names)
    hit = (model.score(x[~r], names) >= 0.5) == (y[~r] == 1)
    balanced = (hit[y[~r] == 1].mean() + hit[y[~r] == 0].mean()) / 2
    assert balanced > 0.8, balanced
    rules = Q.tree_rules(x[r], y[r], names)
    assert 0 < len(model.rules) < len(rules) / 2  # the lasso leaves most rules out
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi").limit(50)
    scored = {s.doc_id: s.score for s in Q.classify(some, labels, model=model).collect()}
    stats = some.select("doc_id", *[c.cast("double").alias(n) for n, c in Q.statistics(F.col("text")).items()]).collect()
    plain = model.score(np.array([[s[n] for n in names] for s in stats]), names)
    assert np.allclose([scored[s.doc_id] for s in stats], plain)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (None, "x"), (2, ""), (2, ""), (3, "word " * 100_000)], "doc_id long, text string").withColumns({"score": F.lit(1), "label": F.lit(2), "label_id": F.lit(1)})
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.good for r in Q.classify(docs, none).collect()] == [True] * 5
    odd = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (2, None), (3, 7)], "doc_id long, quality int")
    assert [r.good for r in Q.classify(docs, odd).collect()] == [False] * 5
    assert Q.classify(docs.where("false"), odd).count() == 0


def contexts(text):
    """(terms, entities, hash of all words) of each context: sentences and lines, in windows of 64 words."""
    spans = P.entities(text)
    place, out = 0, []
    for m in re.finditer(r"[^\n]*?(?:[.!?](?=\s)|\n|$)", text):
        if not m[0]:
            continue
        words = [(place + 0, w) for w in regex.finditer(r"[\p{L}\p{N}]+", text, pos=m.start(), endpos=m.end())]
        for k in range(0, len(words), P.WINDOW):
            part = [w for _, w in words[k : k + P.WINDOW]]
            touched = {e for w in part for a, z, _, e in spans if w.start() < z and a < w.end()}
            plain = {w[0].lower() for w in part if not any(w.start() < z and a < w.end() for a, z, _, _ in spans)}
            out.append((plain, touched, " ".join(w[0].lower() for w in part) if part else ""))
    return out


def brute_disclosing(texts, alpha):
    """{(entity, term)} by plain counting over the contexts of all texts."""
    both, distinct, entity, term, n = Counter(), defaultdict(set), Counter(), Counter(), 0
    for t in texts:
        for plain, touched, whole in contexts(t):
            n += 1
            term.update(plain)
            entity.update(touched)
            for e in touched:
                for w in plain:
                    both[e, w] += 1
                    distinct[e, w].add(whole)
    out = set()
    for (e, w), k in both.items():
        d = len(distinct[e, w])
        bound = 3 * math.log2(1 - 1 / (9 * d) - P.QUANTILE / (3 * d**0.5))
        if math.log2(k / entity[e]) - math.log2(term[w] / n) + bound >= -math.log2(entity[e] / n) / alpha - 1e-9:
            out.add((e, w))
    return out


def term_hash(word):
    cp = np.frombuffer(word.encode("utf-32-le"), np.uint32)
    return int(P.terms(cp, np.array([0, len(cp)]))[2][0])


CORPUS = [f"The meeting number {i} was long. Some people from town {i} left early to sleep and rest in bed." for i in range(600)]
CORPUS += [f"Write to zorro.best@mail.example.com about the Masked rider and case{i} in Spain. The weather was fine." for i in range(8)]
CORPUS += ["The Masked rider came home. Nothing else.", "Call +1 (555) 123-4567 now. The weather is bad.", "Card 4111 1111 1111 1111 and 10.20.30.40 were seen."]


def test_disclosure_same_as_brute_force(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(CORPUS)], "doc_id long, text string")
    over, _ = P.disclosing(docs)
    want = brute_disclosing(CORPUS, P.ALPHA)
    assert {(r.entity, r.term) for r in over.collect()} == {(e, term_hash(w)) for e, w in want} and {w for _, w in want} >= {"masked", "rider", "write", "spain"}
    row = over.where(F.col("n_term") == 9).first()
    assert (row.n_entity, row.n_both) == (8, 8)
    got = {r.doc_id: r for r in P.sanitise(docs).collect()}
    assert len(got) == len(CORPUS)
    assert got[600].text.startswith("[NAME] to [EMAIL]") and "[NAME] and case0" in got[600].text and got[600].text.endswith("in [NAME]. The weather was fine.")
    assert got[608].text == CORPUS[608]  # no entity there, so that nothing is given away
    assert got[609].text.endswith("The weather is bad.") and "[PHONE]" in got[609].text and "[CARD]" in got[610].text and "[IP]" in got[610].text
    assert all(got[i].text == CORPUS[i] and got[i].n_entities == 0 for i in range(600))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_disclosure_on_driver_documents(spark, sf):
    """The same pairs as plain counting over all documents, and terms that go in most documents with an entity in the larger one."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    texts = [r.text for r in docs.select("text").collect() if r.text is not None]
    over, _ = P.disclosing(docs)
    assert {(r.entity, r.term) for r in over.collect()} == {(e, term_hash(w)) for e, w in brute_disclosing(texts, P.ALPHA)}
    done = P.sanitise(docs).agg(F.sum("n_terms"), F.count_if(F.col("n_entities") > 0), F.count_if(F.col("n_terms") > 0), F.count_if((F.col("n_entities") == 0) & (F.col("n_terms") > 0))).first()
    assert done[3] == 0 and (sf == "sf0.001" or (done[0] > 0 and done[2] > done[1] / 4))


def test_contexts_are_cut_at_64_words_and_the_threshold_belongs_to_them(spark):
    words = " ".join(f"w{i}" for i in range(70))
    docs = spark.createDataFrame([(0, f"{words} me@x.example.com tail"), *[(i, f"Plain line number {i} of many.") for i in range(1, 3000)]], "doc_id long, text string")
    [text] = [r.text for r in P.sanitise(docs).where("doc_id = 0").collect()]
    assert text == " ".join(f"w{i}" for i in range(64)) + " [NUMBER]" * 6 + " [EMAIL]"  # those in the entity's window go, the window before stays
    over = P.disclosing(docs)[0].where("pmi < content").collect()
    exact = over[0].content / over[0].pmi
    kept = {r.term for r in P.disclosing(docs, alpha=exact)[0].collect()}
    assert {r.term for r in over} == kept  # exactly at the threshold counts
    assert not P.disclosing(docs, alpha=exact * 0.999)[0].count()


def test_disclosure_from_one_and_two_contexts(spark):
    texts = [f"The meeting number {i} was long. Some people from town {i} left early." for i in range(2000)]  # 4,000 contexts
    texts += ["Reach Quibble Marlowe by +1 (555) 123-4567 at the meeting.", "The weather was fine."]
    texts += ["Mail Vantongeren at zorro.best@mail.example.com about the town.", "Old Vantongeren has zorro.best@mail.example.com from some people."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in P.sanitise(docs).where("doc_id >= 2000").collect()}
    assert got[2000].text == "[NAME] [NAME] [NAME] [PHONE] at the meeting." and got[2000].n_terms == 4
    assert got[2001].text == texts[2001]
    assert got[2002].text == "[NAME] [NAME] at [EMAIL] the town." and got[2003].text == "[NAME] [NAME] [EMAIL] from some people."
    over = P.disclosing(docs)[0].collect()
    assert {(r.n_entity, r.n_both) for r in over} == {(1, 1), (2, 1), (2, 2)}
    for r in over:
        k, raw = r.n_both, math.log2(r.n_both * r.n_contexts / r.n_entity / r.n_term)
        assert math.isclose(r.pmi, raw + 3 * math.log2(1 - 1 / (9 * k) - P.QUANTILE / (3 * k**0.5))) and r.pmi >= r.content / P.ALPHA


def test_sanitise_edges(spark):
    long = "word " * 200_000 + "me@x.example.com"
    rows = [(1, None), (2, ""), (None, "a@b.example.com"), (3, "a@b.example.com"), (3, "a@b.example.com"), (4, long), (5, "@ 1234567 no-one"), (6, "12.5.2020 at 3.14.15")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"terms": F.lit(1), "digest": F.lit(2), "n_terms": F.lit(3)})
    got = sorted((r.doc_id or 0, r.text) for r in P.sanitise(docs).collect() if r.doc_id != 1)
    assert got == [(0, "[EMAIL]"), (2, ""), (3, "[EMAIL]"), (3, "[EMAIL]"), (4, "word " * 200_000 + "[EMAIL]"), (5, "@ 1234567 no-one"), (6, "12.5.2020 at 3.14.15")]
    assert [r.text for r in P.sanitise(docs.where("doc_id = 1")).collect()] == [None]
    assert P.sanitise(docs.where("false")).count() == 0


@pytest.mark.parametrize("text", ["a@b.example.com", "+1 (743) 555-3824", "4381893557741609", "227.5.221.1", "123-45-6789", "DE89 3704 0044 0532 0130 00", "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"])
def test_entities(text):
    assert re.search(P.MAYBE, text)
    for around in ("{}", "x {}, y", "({})", "{}."):
        assert re.fullmatch(re.escape(around).replace(r"\{\}", r"\[[A-Z]+\]"), P.sanitised(around.format(text), set())[0])
