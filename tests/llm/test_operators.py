"""Training-data operators on small tables with the awkward cases; brute force where it is short."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import chat, decontaminate, embeddings, langid, licenses, lm_score, minhash, mixing, pii, quality

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "lambda", "zeta"]


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(rng.integers(0, 10, n), rng.integers(0, 50, n), strict=True))


def docs(spark, rows):
    """With an extra column whose name clashes with what operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, node string")


AWKWARD = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "word", "b"), (4, "word", "b"), (None, "one two three four five six", None), (5, "É " + "long " * 30000, "a")]


def test_minhash(spark):
    a = prose(1, 200)
    b = a.replace(a.split()[100], "changed", 1)
    got = minhash.near_duplicates(docs(spark, [*AWKWARD, (10, a, "a"), (11, b, "a"), (12, a.upper(), "b"), (13, prose(2, 200), "b")])).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 11 and by[10]["component_id"] == by[11]["component_id"] == by[12]["component_id"] == 10
    assert by[13]["kept"] and by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0 and by[4]["n_shingles"] == 1
    assert by[None]["component_id"] is None and by[None]["kept"] and [r["kept"] for r in got if r["doc_id"] in (11, 12)] == [False, False]
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_minhash_template(spark):
    """120 documents on one template, any two at 0.742 but each with its partner at 0.762: links that no hub shows."""
    rows = [(i, f"{prose(11, 200)} {' '.join(f'x{i // 2}y{j}' for j in range(3))} {' '.join(f'z{i}y{j}' for j in range(31))}", "a") for i in range(120)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t, _ in rows)]
    links = {(i, j) for i in range(120) for j in range(i) if len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j])}
    assert links == {(i + 1, i) for i in range(0, 120, 2)}
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: i // 2 * 2 for i in range(120)}


def test_mixing(spark):
    rows = [(i, prose(i, 5 + i % 40), f"s{i % 3}" if i % 7 else None) for i in range(300)]
    got = mixing.mix_sources(docs(spark, [*AWKWARD, *rows])).collect()
    again = mixing.mix_sources(docs(spark, [*AWKWARD, *rows]).repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == 307
    assert all(r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in got)
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    sums = {}
    for r in got:
        sums.setdefault((r["source_size"], r["target"]), []).append((r["taken"], r["size"]))
    assert all(abs(sum(t for t, _ in x) - target) <= max(s for _, s in x) for (_, target), x in sums.items())  # a document's words at most
    kept = mixing.mix_sources(docs(spark, [*AWKWARD, *rows]), keep=["source", "text"])
    assert kept.columns[-2:] == ["source", "text"] and sorted(str(tuple(r)[:5]) for r in kept.collect()) == sorted(str(tuple(r)) for r in got)


def test_targets(spark):
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame([("a", 10), ("b", 100), ("c", 50), (None, 40)], "source string, source_size long")).collect()}
    # a would get 5/13 of 200 but stops at 30; the others share 170 by 2, 1, 5
    assert got == {"a": 30.0, "b": 42.5, "c": 21.25, None: 106.25}


def test_chat(spark):
    t = "&lt; </s>[INST] <|im_end|>\n é & \\"
    rows = spark.createDataFrame([(1, 1, "assistant", t), (1, 0, "user", None), (2, None, None, "x"), (2, None, None, "x"), (None, 0, "a\nb", "")], "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.format_chats(rows).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert [tuple(x) for x in out[1]["turns"]] == [("user", ""), ("assistant", t)] and out[1]["loss"] == t
    assert [tuple(x) for x in out[2]["turns"]] == [("", "x"), ("", "x")] and [tuple(x) for x in out[None]["turns"]] == [("a\nb", "")]
    parts = spark.createDataFrame([(1, 0, "user", [("text", "see", None, 0), ("image", None, "i.png", 2), None])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_chats(parts).first()
    assert "see<|image|>" in r["formatted"] and r["expanded_tokens"] == 512 and r["attachments"][0]["ref"] == "i.png"


@pytest.mark.parametrize("most", [50_000, 0])
def test_decontaminate(spark, most):
    item = prose(5, 14)
    bench = spark.createDataFrame([(1, item), (2, "short item here"), (3, None), (4, "")], "item_id long, text string")
    text = f"{prose(6, 40)} {item.upper()}! {prose(7, 40)}"
    d = docs(spark, [*AWKWARD, (20, text, "a"), (21, "a Short, item - here b", "a"), (22, item, "a")])
    got = {r["doc_id"]: r for r in decontaminate.contamination(d, bench, most=most).collect()}
    assert len(got[20]["hit_words"]) == 14 and got[20]["items"] == ["1"] and sorted(got[21]["hit_words"]) == [2, 3, 4] and got[1]["n_words"] == 0 and not got[5]["hit_words"]
    kept = {r["doc_id"]: r for r in decontaminate.decontaminated(d, bench, most=most).collect()}
    assert 22 not in kept and item.split()[3].upper() not in kept[20]["text"] and kept[20]["text"].startswith(prose(6, 40)) and kept[5]["text"].startswith("É") and kept[1]["text"] is None


def cut_by_hand(text, item, window):
    """The words of the text as (start, end), those of the item's windows cut."""
    spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    words, of = [text[a:b].lower() for a, b in spans], [x.lower() for x in re.findall(r"[^\W_]+", item)]
    grams = {tuple(of[i : i + window]) for i in range(len(of) - window + 1)}
    hit = {j for i in range(len(words) - window + 1) if tuple(words[i : i + window]) in grams for j in range(i, i + window)}
    for j in sorted(hit, reverse=True):
        text = text[: spans[j][0]] + text[spans[j][1] :]
    return text


@pytest.mark.parametrize("most", [50_000, 0])
def test_decontaminate_capitals(spark, most):
    item = "The quick iPhone of NASA and I jumped over A lazy USA dog"
    lead = "I met The Old Man At A Pub In USA And NASA Told Us " * 2
    texts = [f"{lead}{item}, so {prose(8, 30)} END", f"A {item.upper()} {prose(9, 30)} I", f"É {prose(3, 20)} I, {item.lower()}! The End {prose(4, 9)}", f"{item} {lead}", f"{lead} no passage"]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.decontaminated(docs(spark, [(i, t, "a") for i, t in enumerate(texts)]), bench, most=most).collect()}
    assert {i: r["text"] for i, r in got.items()} == {i: cut_by_hand(t, item, 10) for i, t in enumerate(texts)}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and got[4]["text"] == texts[4] and "jumped" not in got[0]["text"]


def test_decontaminate_paths_agree(spark):
    """The set in the plan, the broadcast hashes and the shuffled hashes find the same, with columns that clash."""
    bench = spark.createDataFrame([(1, prose(5, 30)), (2, "a b c"), (3, prose(6, 12))], "item_id long, text string")
    texts = [prose(5, 30), f"{prose(9, 20)} {prose(6, 12)} a b c", "a b c a b c", "nothing here", None, ""]
    d = spark.createDataFrame([(i, t, "x", 7, [1], "y") for i, t in enumerate(texts)], "doc_id long, text string, hits string, n_words int, scan array<int>, new string")
    got = [sorted(map(str, decontaminate.contamination(d, bench, most=m, broadcast=b).collect())) for m, b in ((50_000, 1), (0, 1000), (0, 0))]
    assert got[0] == got[1] == got[2] and len(got[0]) == 6
    cut = [sorted(map(str, decontaminate.decontaminated(d, bench, most=m).collect())) for m in (50_000, 0)]
    assert cut[0] == cut[1] and decontaminate.decontaminated(d, bench).columns == d.columns
    assert decontaminate.decontaminated(d, bench.limit(0)).count() == 6 and decontaminate.contamination(d.limit(0), bench).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(120, 12))
    v[60:] = v[:60] + rng.normal(scale=0.05, size=(60, 12)) * np.linspace(0, 3, 60)[:, None]
    rows = [(i, x.tolist(), i % 3 if i % 11 else None) for i, x in enumerate([*v, v[3]])] + [(500, None, 1), (501, [0.0] * 12, 1), (502, [float("nan")] * 12, 1), (None, v[1].tolist(), 1), (503, [], 1)]
    got = {r["vec_id"]: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x, l in rows if i is not None and i < 500 and l is not None}
    lab = {i: l for i, _, l in rows}
    for i, a in unit.items():
        assert got[i]["n_links"] == sum(j != i and lab[j] == lab[i] and a @ b >= 0.98 for j, b in unit.items())
    assert len(got) == len(rows) and all(got[i]["n_links"] == 0 for i in (500, 501, 502, 503, None, 11))
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_embeddings_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    monkeypatch.setattr(embeddings, "CODE_BLOCK", 100)
    monkeypatch.setattr(embeddings, "CELLS", 3)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(1500, 24))
    v[:400] = v[0] + rng.normal(scale=0.09, size=(400, 24))  # many links, and many pairs just below
    v[400:600] = v[600:800] + rng.normal(scale=0.14, size=(200, 24))
    label = np.arange(1500) % 7 == 0
    rows = [(i, x.tolist(), bool(b)) for i, (x, b) in enumerate(zip(v, label, strict=True))]
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    linked = (unit @ unit.T >= 0.98) & (label[:, None] == label)
    low = np.arange(1500)
    for _ in range(50):
        low = np.where(linked, low[None], 1500).min(axis=1)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label boolean"), sample=500).collect()}
    assert 20_000 < linked.sum() < 150_000
    assert got == {i: (int(linked[i].sum()) - 1, int(low[i])) for i in range(1500)}


def test_licenses(spark):
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs(spark, [*AWKWARD, (30, prose(1, 50) + "\nRELEASED under the  MIT license\n" + prose(2, 9), "a"), (31, "All rights reserved.", "a")])).collect()}
    assert got[30]["license"] == "MIT" and got[30]["dice"] == 1.0 and got[31]["license"] == "proprietary" and got[1]["license"] is None and got[5]["license"] is None
    assert licenses.dice(licenses.bigrams("a b c"), licenses.bigrams("a b d")) == 0.5


def test_licenses_wrapped(spark):
    mit, apache = licenses.TEMPLATES["MIT"][1].split(), licenses.TEMPLATES["Apache-2.0"][1].split()
    wrap = lambda w, mark="": "\n".join(mark + " ".join(w[i : i + 9]) for i in range(0, len(w), 9))
    texts = [f"{prose(1, 60)}\n{wrap(mit)}\n{prose(2, 200)}", f"{prose(3, 9)}\n{wrap(apache, '# ')}\n{prose(4, 90)}", f"{prose(5, 30)} all rights reserved. {prose(6, 30)}", f"{wrap(mit)}\n{prose(7, 50)}\n{wrap(apache, ' * ')}", f"{prose(8, 90)}\nrights of all reserved"]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert [got[i]["license"] for i in range(5)] == ["MIT", "Apache-2.0", "proprietary", "MIT", None]
    assert all(got[i]["dice"] == 1.0 for i in range(4)) and got[0]["n_matches"] == 1 and got[3]["n_matches"] == 2


def test_licenses_versions(spark):
    notices = [(name, t) for name, ts in licenses.TEMPLATES.items() for t in ts]
    rows = [(i, f"{prose(i, 40)}\n" + "\n".join(f"// {' '.join(t.split()[k : k + 8])}" for k in range(0, len(t.split()), 8)), "a") for i, (_, t) in enumerate(notices)]
    got = {r["doc_id"]: r["license"] for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    assert got == {i: name for i, (name, _) in enumerate(notices)} and {"GPL-2.0", "GPL-3.0"} <= set(got.values())


def test_licenses_runs():
    rng = np.random.default_rng(4)
    template = licenses.bigrams("a b c a b d e f a c")
    for _ in range(200):
        words = [*map(str, rng.choice(list("abcdefx"), 25))]
        grams = list(zip(words, words[1:], strict=False))
        got = max((r[0] for r in licenses.runs(grams, [i for i, x in enumerate(grams) if x in template], template, 0.5)), default=0.0)
        want = max(licenses.dice(licenses.Counter(grams[i:j]), template) for i in range(24) for j in range(i + 1, 25))
        assert got == (pytest.approx(want) if want >= 0.5 else 0.0)


def test_language(spark):
    en, de = "the house and the garden are near the river in this town ", "das haus und der garten sind nahe am fluss in dieser stadt "
    dicts = langid.dictionaries(spark.createDataFrame([("en", en * 3, 1), ("de", de * 3, 2), (None, "x" * 40, 3), ("fr", None, 4)], "lang string, text string, pick long"))
    got = {r["doc_id"]: r for r in langid.identify(docs(spark, [*AWKWARD, (40, "garden near the river", "a"), (41, "GARTEN nahe am Fluss", "a"), (42, "123 !!", "a")]), dicts).collect()}
    assert (got[40]["lang_pred"], got[41]["lang_pred"]) == ("en", "de") and all(got[i]["lang_pred"] == "und" for i in (1, 2, 3, 42)) and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.identify(docs(spark, AWKWARD), {}).collect()} == {"und"}


def test_quality(spark):
    rows = [(i, prose(i, 60) if i % 2 else " ".join([f"junk{i % 5}"] * 60), i % 2) for i in range(200)]
    weights = quality.train(spark.createDataFrame([*rows, (900, None, 1), (901, "x", None)], "doc_id long, text string, label int"))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs(spark, [*AWKWARD, (50, prose(999, 60), "a"), (51, " ".join(["junk3"] * 50), "a")]), weights, ["doc_id"]).collect()}
    assert got[50] > 0.5 > got[51] and all(0 <= s <= 1 for s in got.values())
    empty = quality.train(spark.createDataFrame([], "doc_id long, text string, label int"))
    assert {r["score"] for r in quality.score(docs(spark, AWKWARD), empty, ["doc_id"]).collect()} == {0.5}


PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(digits[::-1])) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


TEXTS = ["é a.b@c.d_e@f.gh mail x@y", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111 1111-1111 1111 and 4111111111111112 12", "+1 (555) 555-1234) +49-30 1234567 +1+1", "1 " * 5000, "a" * 20000 + "@b.c", "1.1.1.1 " * 700, "token = " + "ab12" * 10]


def test_pii(spark):
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs(spark, [*AWKWARD, *((60 + i, t, "a") for i, t in enumerate(TEXTS))])).collect()}
    for i, t in enumerate(TEXTS):
        want = [(pii.KINDS.index(k), m.start(), m.end()) for k, p in PLAIN for m in re.finditer(p, t) if valid(k, m.group())]
        assert [(s["kind"], s["start"], s["end"]) for s in got[60 + i] if s["base"]] == want, t[:40]
    out = {r["doc_id"]: r["text"] for r in pii.redacted(docs(spark, [(1, "to a@b.cd or +1 (555) 555-1234.", "a"), (2, "plain", "a"), (3, None, "a")])).collect()}
    assert out == {1: "to [EMAIL] or [PHONE].", 2: "plain", 3: None}
    assert pii.find_pii(docs(spark, [])).count() == 0


def test_pii_rejects(spark):
    """Candidates that the labelers speak against fall, others of the kind stay; clashing columns are kept."""
    rng = np.random.default_rng(3)
    secrets = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(40)]
    rows = [(i, f"{prose(i, 9)} token = {s} {prose(i, 3)}") for i, s in enumerate(secrets)] + [(100 + i, f"order sku part1-{'-'.join(['a'] * 12)}.x {prose(i, 5)}") for i in range(30)]
    rows += [(200 + i, f"call (212) 555-{1000 + i}, {prose(i, 4)}") for i in range(20)] + [(300 + i, f"version 000-555-{1000 + i}.3 {prose(i, 4)}") for i in range(20)]
    d = spark.createDataFrame([(i, t, "f", "n", 1) for i, t in rows], "doc_id long, text string, found string, new string, spans int")
    got = {r["doc_id"]: [pii.KINDS[s["kind"]] for s in r["spans"] if not s["base"]] for r in pii.find_pii(d).collect()}
    assert all(got[i] == ["secret"] for i in range(40)) and all(got[i] == [] for i in range(100, 130))
    assert all(got[i] == ["phone"] for i in range(200, 220)) and all(got[i] == [] for i in range(300, 320))
    out = pii.redacted(d)
    assert out.columns == d.columns and {(r["found"], r["new"], r["spans"]) for r in out.collect()} == {("f", "n", 1)} and pii.redacted(d.limit(0)).count() == 0


def test_pii_em():
    """Three kinds of truth with labelers of known reliability: EM finds who is to be believed."""
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.6
    right = [0.95, 0.9, 0.5, 0.8, 0.7, 0.55]  # the third says nothing
    votes = np.stack([np.where(rng.random(4000) < r, truth, ~truth) for r in right], axis=1) * 2 - 1
    counts: dict = {}
    for v in votes:
        code = 5
        for x in v:
            code = code * 3 + int(x) + 1
        counts[code * pii.BUCKETS, False] = counts.get((code * pii.BUCKETS, False), 0) + 1
    codes, told = pii.fit(counts)
    found = np.array([sum((int(x) + 1) * 3 ** (5 - j) for j, x in enumerate(v)) + 5 * 729 for v in votes]) * pii.BUCKETS
    assert np.mean(np.isin(found, sorted(codes)) == truth) > 0.95 and abs(told["prior"]["secret"] - 0.6) < 0.05
    assert all(abs((told["reliability"]["secret"][j][0] + told["reliability"]["secret"][j][1]) / 2 - r) < 0.06 for j, r in enumerate(right))


def test_lm_score_further_groups(spark):
    rng = np.random.default_rng(3)
    words = [["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(40)] for _ in range(7)]
    rows = [(200 * k + i, " ".join(rng.choice(words[k], 30)), None if k == 6 else f"l{k}", i > 3) for k in range(7) for i in range(24 - 2 * k)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, train boolean")
    one, many = ({r["doc_id"]: r["score"] for r in lm_score.score_documents(x).collect()} for x in (d.drop("lang"), d))
    # a text of a further group, or of none, costs at most the share of all rows more than without groups
    rest = sum(t and lang not in ("l0", "l1", "l2", "l3") for _, _, lang, t in rows) + 1
    share = np.log10(rest / (sum(r[3] for r in rows) + 5))
    assert all(many[i] > one[i] + share - 0.1 for i, _, lang, _ in rows if lang not in ("l0", "l1", "l2", "l3"))
    # training texts meet their own passages either way; the groups help the texts that are held out
    assert sum(many[i] > one[i] for i, _, lang, learn in rows if lang == "l0" and not learn) == 4


def test_lm_score(spark):
    rows = [(i, prose(i, 80), i % 5 != 0) for i in range(60)] + [(100, None, True), (101, "", False), (102, "new\x04word  x", False), (None, "alpha1", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    got = {r["doc_id"]: r for r in lm_score.score_documents(d).collect()}
    words = [w for _, t, k in rows if k for w in (t or "").split()]
    ends = sum(bool(k) for *_, k in rows)
    n, v = len(words) + ends, len(set(words)) + 1
    assert all(r["train_tokens"] == n for r in got.values()) and got[101]["n_tokens"] == 1
    want = sum(np.log10((words.count(w) + 1) / (n + v + 1)) for w in rows[0][1].split()) + np.log10((ends + 1) / (n + v + 1))
    assert got[0]["base_score"] == pytest.approx(want) and got[0]["bits_per_byte"] < 5 and len(got) == len(rows)
    empty = spark.createDataFrame([], "doc_id long, text string, train boolean")
    assert lm_score.score_documents(empty).count() == 0
    assert zlib.crc32(b"12") % 7 == spark.range(12, 13).select(F.crc32(F.col("id").cast("string").cast("binary")) % 7).first()[0]


def test_lm_passages():
    """Passages of units against a loop: the same borders and contexts, and equal hashes for equal contexts and units alone."""
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 63, 40, dtype=np.uint64)[rng.integers(0, 40, 12000)]
    h[8001:8801] = h[:800]
    text = np.repeat(np.arange(5), [6000, 2, 1998, 1, 3999])
    which, context, own, where = lm_score.passages(h, text)
    seen, start, before = {}, 0, ()
    for i in range(len(h)):
        closes = i + 1 == len(h) or text[i + 1] != text[i]
        if closes or (i + 1 < len(h) and which[i + 1] != which[i]):
            p = which[i]
            assert set(which[start : i + 1]) == {p} and where[p] == text[i]
            seen.setdefault((before, tuple(h[start : i + 1])), set()).add(own[p])
            assert (context[p] == 0) == (before == ())
            before, start = (() if closes else tuple(h[i + 1 - lm_score.LAST : i + 1])), i + 1
    hashes = [x for v in seen.values() for x in v]
    assert all(len(v) == 1 for v in seen.values()) and len(set(hashes)) == len(hashes) == len(set(own)) and 60 < len(own) < 150
    assert [len(x) for x in lm_score.passages(h[:0], text[:0])] == [0, 0, 0, 0]


def test_lm_repeats(spark):
    """One model for all rows: a training text, its repeat and a held-out copy score alike; texts that teach nothing and occur once don't gain."""
    rows = [(i, prose(i, 120), i % 7 != 0) for i in range(60)] + [(100, prose(3, 120), True), (101, prose(5, 120), False), (102, prose(7, 120), False)]
    d = spark.createDataFrame([*rows, (103, "x " * 40000, False)], "doc_id long, text string, train boolean")
    got = {r["doc_id"]: r for r in lm_score.score_documents(d.withColumn("N", F.lit(1)).withColumn("block", F.lit("x"))).collect()}
    once = [got[i]["bits_per_byte"] for i, _, learn in rows if not learn and i != 101]
    assert got[3]["score"] == got[100]["score"] and got[5]["score"] == got[101]["score"] and got[7]["score"] == got[102]["score"]
    assert max(got[i]["bits_per_byte"] for i in (3, 5, 100, 101)) < 0.8 * min(once) and got[7]["bits_per_byte"] >= min(once)
    assert got[103]["n_tokens"] == 40001


def test_lm_groups(spark):
    rows = [(i, (prose(i, 60) if i % 2 else " ".join(f"mot{j}" for j in np.random.default_rng(i).integers(0, 90, 60))), ("en", "fr")[1 - i % 2] if i % 9 else None, i % 4 != 0) for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, train boolean")
    one, many = ({r["doc_id"]: r for r in lm_score.score_documents(x).collect()} for x in (d.drop("lang"), d))
    held = [i for i, *_, learn in rows if not learn]
    assert sum(many[i]["score"] for i in held) > sum(one[i]["score"] for i in held)
    assert all(many[i]["base_score"] == pytest.approx(one[i]["base_score"]) for i in many)
    # the language of the text itself is no input of its score
    other = {r["doc_id"]: r for r in lm_score.score_documents(d.withColumn("lang", F.when(F.col("train"), F.col("lang")))).collect()}
    assert all(other[i]["score"] == pytest.approx(many[i]["score"], rel=1e-5) for i in held)


def test_lm_shapes(spark):
    units = [b"\x00Word, ", b"\x01WORDS ", b"\x00wOrd ", b"\x0012-3 ", b"\x00\xff", "\x01(Été)\n".encode()]
    assert [lm_score.shape(u) for u in units] == [b"\x00\xf9, ", b"\x01\xfa ", b"\x00\xfb ", b"\x0012-3 ", b"\x00\xff", b"\x01(\xf8)\n"]
    got = [r[0] for r in spark.createDataFrame([(u[1:-1].decode(),) for u in units], "b string").select(lm_score.core(F.col("b"))).collect()]
    assert got == ["word", "words", "wOrd", "", "", "Été"]
