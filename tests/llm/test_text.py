"""The text problems on small rows and against the public libraries."""

from __future__ import annotations

import random

import pytest

from skein.llm import docpairs as D
from skein.llm import mixing as M
from skein.llm import pii as P
from skein.llm import tokens as T
from skein.llm.pii_text import Piece, candidates

DOC = "doc_id long, text string, lang string, source string"


# 5 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("doc", "want"),
    [
        ("/** Opens it.\n   * @param x the thing\n   *   and more\n   * @returns y\n   */", "Opens it."),
        ("/// <summary>\n/// Says <c>hi</c>.\n/// </summary>\n/// <param name=\"a\">b</param>", "Says hi ."),
        ("Walks the rows.\n\n    Args:\n        x: the y\n\n    Returns:\n        z", "Walks the rows."),
        ("Walks.\n\n    :param x: y\n    :return: z", "Walks."),
        ("/// Reads.\n///\n/// # Arguments\n/// * `x` - the y", "Reads."),
        ("Load loads rows.\n\nDeprecated: use Other.", "Load loads rows."),
        ("// one\n// two", "one\ntwo"),
        ("/**\r\n * a\r\n */", "a"),
        (None, ""), ("   ", ""), ("/** */", ""),
    ],
)
def test_description(doc, want):
    assert D.describe(doc) == want


@pytest.mark.parametrize(
    "text", ["", "openCell", "`openCell()`", "Opens the cell.", "To open a cell", "This function opens cell", "The open cell method.", "TODO: document this", "À compléter", "{@inheritDoc}", "@override", "See base class.", "Inherited from Cell.", "noqa", "eslint-disable-next-line no-x", "SPDX-License-Identifier: MIT", "-----", "***", "?", "return this.cell(x);", "if (cell == null) return;", "const a = b.c();"],
)
def test_trivial(text):
    assert D.trivial(text, "openCell")


@pytest.mark.parametrize("text", ["Opens the cell until the batch settles.", "Retries cells.", "cell を突き合わせ、行だけを返す。", "openCell is the entry. Keeps at most 3 rows."])
def test_not_trivial(text):
    assert not D.trivial(text, "openCell")


def test_inherited_documentation(spark):
    s = "id string, name string, kind string, file_path string, signature string, docstring string, parent_id string, language string, indexed_at bigint"
    c = lambda i, n: (i, n, "class", "r/f", f"class {n}", None, None, "java", 1)
    m = lambda i, p, doc, sig="void run()": (i, "run", "method", "r/f", sig, doc, p, "java", 1)
    sym = [c("A", "A"), c("B", "B"), c("C", "C"), m("A.run", "A", "/** Drains the queue before it stops. */"), m("B.run", "B", None), m("C.run", "C", "{@inheritDoc}"), m("C.x", "C", "Real words here.", " "), m("C.n", None, None)]
    edge = [("B", "A", "extends"), ("C", "pkg.B", "extends"), ("A", "C", "implements"), ("C", "A", "calls"), ("C", None, "extends")]
    df = D.documented_functions(spark.createDataFrame(sym, s), spark.createDataFrame(edge, "from_id string, to_id string, kind string"))
    got = {r["id"]: (r["source"], r["described_in"], r["level"], r["description"]) for r in df.collect()}
    text = "Drains the queue before it stops."
    assert got == {"A.run": ("own", "A.run", 0, text), "B.run": ("inherited", "A.run", 1, text), "C.run": ("inherited", "A.run", 2, text)}
    assert D.documented_functions(spark.createDataFrame([], s), spark.createDataFrame([], "from_id string, to_id string, kind string")).count() == 0


def _brute_inherited(sym, links, own):
    """Breadth first up the bases from each undocumented method, nearest level first, smallest id on it."""
    out = {}
    for i, name, parent in sym:
        at, seen, level = {parent}, {parent}, 0
        while i not in own and at and i not in out:
            level += 1
            at = {b for a in at for b in links.get(a, ())} - seen
            seen |= at
            hits = sorted(j for j, n, p in sym if p in at and n == name and j in own)
            if hits:
                out[i] = (hits[0], level)
    return out


def test_inherited_documentation_against_brute_force(spark):
    rnd = random.Random(5)
    classes = [f"c{i:02}" for i in range(30)]
    links = {c: {b for b in rnd.sample(classes, 2) if b != c and rnd.random() < 0.6} for c in classes}
    methods = [(f"{c}.{n}", n, c) for c in classes for n in ("open", "close", "seal") if rnd.random() < 0.7]
    own = {i for i, _, _ in methods if rnd.random() < 0.25}
    s = "id string, name string, kind string, file_path string, signature string, docstring string, parent_id string, language string, indexed_at bigint"
    sym = [(c, c, "class", "r/f", "class", None, None, "java", 1) for c in classes]
    sym += [(i, n, "method", "r/f", "void x()", f"Waits for the gate of {c} before it goes on." if i in own else None, c, "java", 1) for i, n, c in methods]
    edge = [(c, b, rnd.choice(["extends", "implements"])) for c in classes for b in links[c]]
    df = D.documented_functions(spark.createDataFrame(sym, s), spark.createDataFrame(edge, "from_id string, to_id string, kind string"))
    got = {r["id"]: (r["described_in"], r["level"]) for r in df.collect()}
    assert got == {i: (i, 0) for i in own} | _brute_inherited(methods, links, own)


def test_bases_of_file_code_and_of_several_choices(spark):
    s = "id string, name string, kind string, file_path string"
    sym = [("a", "A", "class", "r/one"), ("b", "B", "class", "r/two"), ("b2", "B2", "class", "r/two"), ("x1", "X", "class", "q/x"), ("x2", "X", "struct", "p/x"), ("e", "E", "interface", "q/e")]
    edge = [("r/one::__module__::class", "q.E<T>", "implements"), ("r/two::__module__::class", "E", "extends"), ("b", "X", "extends"), ("b", "a", "extends"), ("b2", "Nowhere", "extends"), ("r/none::__module__::class", "E", "extends"), (None, "E", "extends"), ("b", None, "extends")]
    got = {tuple(r) for r in D.base_links(spark.createDataFrame(sym, s), spark.createDataFrame(edge, "from_id string, to_id string, kind string")).collect()}
    assert got == {
        ("a", "q.E<T>", "e", "anywhere", 1), (None, "E", None, "ambiguous", 2), ("b", "X", None, "ambiguous", 2), ("b", "a", "a", "id", 1),
        ("b2", "Nowhere", None, "unknown", 0), (None, "E", None, "unknown", 0),
    }


# 7 ---------------------------------------------------------------------------------------------


def test_ids_equal_both_libraries(spark):
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    rnd = random.Random(7)
    kinds = [lambda: rnd.randrange(32, 127), lambda: rnd.randrange(0xA0, 0x3000), lambda: rnd.randrange(0x3000, 0xD7FF), lambda: rnd.randrange(0x10000, 0x1FFFF), lambda: 32, lambda: 10]
    texts = ["".join(chr(rnd.choice(kinds)()) for _ in range(rnd.randrange(300))) for _ in range(200)]
    texts += ["<|endoftext|>", "a" * 3000, "ab" * 500 + " " * 700, "don't 'LL\r\n\r\n  x", "\x1c\x85 ​", "é́", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in T.document_ids(df).collect()}
    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    hf.encode_special_tokens = True
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, t in enumerate(texts):
        assert got[i] == hf.encode(t, add_special_tokens=False).ids == tik.encode_ordinary(t)
    assert got[-1] == []
    assert T.document_ids(df.where("false")).count() == 0


# 8 ---------------------------------------------------------------------------------------------


def test_mixture_keeps_shares_caps_and_tokens(spark):
    rnd = random.Random(8)
    docs = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(rnd.randrange(60))), "en", rnd.choice(["big", "big", "big", " Small ", "small-one", None])) for i in range(400)]
    docs += [(1000, None, "en", "big"), (1001, "", "en", "big")]
    df = spark.createDataFrame(docs, DOC)
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.3, 3), ("small_one", 0.2, 1), ("none", 0.1, 5), ("off", 0.0, 1), (None, 0.2, 1)], "source string, weight double, max_repeats int")
    blocks, totals = M.packed_blocks(df, 16)
    packed = {(r["source"], r["block_no"]): r["ids"] for r in blocks.collect()}
    encoder = T.Encoder(T.load(T.default_path()))
    want = {}
    for _, text, _, source in docs:
        if source:
            k = source.strip().lower().replace("-", "_")
            want.setdefault(k, []).extend(encoder.encode([text or ""])[0])
    for k, ids in want.items():
        mine = [t for (s, _), b in sorted(packed.items()) if s == k for t in b]
        assert sorted(mine) == sorted(ids)
        assert all(len(packed[s, n]) == 16 for s, n in packed if s == k and n < max(m for t, m in packed if t == k))
    mixed = M.mixture(df, targets, block=16, shard=8)
    out = mixed.collect()
    assert len({(r["shard"], r["slot"]) for r in out}) == len(out) == len({(r["source"], r["block_no"], r["use_no"]) for r in out})
    share = {s: sum(r["source"] == s for r in out) / len(out) for s in ("big", "small", "small_one")}
    assert all(abs(share[s] - w) < 1.5 / len(out) + 1e-9 for s, w in (("big", 0.5), ("small", 0.3), ("small_one", 0.2)))
    assert all(r["use_no"] < {"big": 2, "small": 3, "small_one": 1}[r["source"]] for r in out)
    report = {r["source"]: r for r in M.share_report(df, targets, mixed).collect()}
    assert report[None]["n_docs"] == sum(d[3] is None for d in docs) and report[None]["tokens_used"] == 0
    assert all(r["share_kept"] and r["repeats_kept"] for r in M.shares_kept(M.share_report(df, targets, mixed), 16).collect())
    assert report["none"]["tokens_used"] == 0 and abs(report["big"]["actual_share"] - 0.5) < 0.05
    assert M.mixture(df.where("false"), targets).count() == 0


def test_permutation_is_one():
    import numpy as np

    for n in (1, 2, 3, 10, 257):
        got = M._permuted(np.arange(n), np.full(n, n), np.full(n, 99))
        assert sorted(got.tolist()) == list(range(n))


# 9 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("mail a.b+c@kontor.example, or", ["a.b+c@kontor.example"]), ("x_y AT kontor DOT example", ["x_y AT kontor DOT example"]), ("<a-b%40post.invalid>", ["a-b%40post.invalid"]),
        ("git@code.example.org:harbor/core.git", []), ("postgres://app:pw@db.ops.test:5432/x", []), ("relay-kit@4.2.1", []), ("user@ and <name>@<host>", []),
        ("call (+49 30 23125 812)", ["+49 30 23125 812"]), ("((617) 555 0128)", ["(617) 555 0128"]), ("030/23125-731 ext. 12", ["030/23125-731"]), ("build 20240342.91 at 10.92.15.7", []),
        ("NIR: 9 46 13 05 047 935 81,", ["9 46 13 05 047 935 81"]), ("ssn:: 931-03-8931", ["931-03-8931"]), ("NINO QQ146192C", ["QQ146192C"]), ("ticket HC-1, rev 625-54-729", []),
        ("at 57 Thistledown St..", ["57 Thistledown St."]), ("102 North Thistledown Rd.", ["102 North Thistledown Rd"]), ("12 bis rue des Trois Grues, X", ["12 bis rue des Trois Grues"]),
        ("Calle de la Dársena 185'", ["Calle de la Dársena 185"]), ("Kranführerstr. 49b", ["Kranführerstr. 49b"]), ("Am Speicherhof 12a", ["Am Speicherhof 12a"]), ("the 12 Way merge", []),
    ],
)
def test_forms(line, want):
    assert [line[s:e] for s, e, _, _ in candidates(line)] == want


@pytest.mark.parametrize("blank", ["\u00a0", "\u202f", "\u2007", "\u3000"])
def test_forms_with_other_blanks(blank):
    lines = ["call +49 30 23125 595 now", "+61 2 5550 2395", "NIR: 9 46 13 05 047 935 81,", "at 57 Thistledown Road", "x_y AT kontor DOT example"]
    for line in lines:
        other = line.replace(" ", blank) if " AT " not in line else line.replace("x_y ", f"see{blank}x_y ")
        want = [line[s:e] for s, e, _, _ in candidates(line)]
        assert want and [other[s:e].replace(blank, " ") for s, e, _, _ in candidates(other)] == want
    piece = Piece(f"Ada{blank}Birkvane\n+49{blank}30{blank}23125{blank}595", {})
    assert "Birkvane" in piece.words and [k for _, _, k, _ in piece.found] == [2]


def test_redaction_finds_names_and_keeps_the_rest(spark):
    given, family = ["Amara", "Rurik", "Noor", "Otto", "Femke", "Zoë"], ["Quellmar", "Birkvane", "Corvessy", "Halvessen", "Ostrelin"]
    rnd = random.Random(9)
    docs = []
    for i in range(240):
        g, f = rnd.choice([*given, "Bruna"]), rnd.choice([*family, "Ferrolane"])
        text = rnd.choice(["Reviewed-by: {}\nThe queue is shut.", "Thanks to {} for the trace!\n", "Please ask {} before touching the table.\r\n", "author: {}"]).format(f"{g} {f}" if i % 3 else f"{f}, {g}")
        docs.append((i, text + f" Mail {g.lower()}@kontor.example" * (i % 2), "en", "x"))
    docs += [(1000, None, "en", "x"), (1001, "", "en", "x"), (1002, "The Otto Sweep pass runs. Reviewed-by: O. Birkvane", "en", "x"), (1003, "M. Noor von Ostrelin 😀 confirme", "fr", "x"), (1004, "M. K. Birkvane confirme", "fr", "x")]
    known = spark.createDataFrame([(n, "given") for n in given] + [(n, "family") for n in family] + [(None, "given"), ("Otto", "given")], "name string, name_kind string")
    df = spark.createDataFrame(docs, DOC)
    out = {r["doc_id"]: r for r in P.redact(df, known).collect()}
    found = {(r["doc_id"], r["pii_type"], r["pii_value"]) for r in P.found_items(P.redact(df, known)).collect()}
    names = {d: v for d, t, v in found if t == "name"}
    assert sum(i in names for i in range(240)) >= 230
    assert out[1000]["redacted"] is None and out[1001]["redacted"] == ""
    assert names[1002] == "O. Birkvane" and names[1003] == "Noor von Ostrelin" and names[1004] == "K. Birkvane"
    for i, text, _, _ in docs:
        if text:
            back, shift = out[i]["redacted"], 0
            for item in out[i]["items"]:
                mark = f"[{item['pii_type'].upper()}]"
                at = item["start"] + shift
                assert back[at : at + len(mark)] == mark and text[item["start"] : item["end"]] == item["pii_value"]
                back = back[:at] + item["pii_value"] + back[at + len(mark) :]
            assert back == text
    nothing = P.redact(df.where("false"), known.where("false"))
    assert nothing.count() == 0


def test_skip_edges_join_similar_tokens():
    piece = Piece("Reviewed-by: Amara Quellmar\nx\nMail AMARA.quellmar@kontor.example", {"amara": "given", "quellmar": "family"})
    _, edges = P.chains_of(piece)
    assert len(edges) == 4 and len({g for g, _, _ in edges}) == 2


def test_field_agrees_with_enumeration():
    """Belief propagation against all labelings of a small model: exact without skip edges."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    model = {"w": rng.normal(size=(4, P.K)).astype("float32"), "trans": rng.normal(size=(P.K, P.K)).astype("float32"), "skip": np.zeros((P.K, P.K), "float32")}
    model["w"][-1] = 0
    chain = [[0], [1, 2], [2]]
    pot = np.array([model["w"][f].sum(0) for f in chain])
    total = np.zeros((3, P.K))
    for y in itertools.product(range(P.K), repeat=3):
        p = np.exp(sum(pot[i][y[i]] for i in range(3)) + model["trans"][y[0], y[1]] + model["trans"][y[1], y[2]])
        for i in range(3):
            total[i, y[i]] += p
    want = total / total.sum(1, keepdims=True)
    got = P.posterior(model, [chain, [[0]]], [])[0]
    assert np.allclose(got, want, atol=1e-4)


def test_names_of_a_long_list_are_found_across_chains():
    import numpy as np

    people = [(f"Amara{chr(97 + i % 26)}{chr(97 + i // 26)}", f"Quell{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(300)]
    lexicon = {g.lower(): "given" for g, _ in people} | {f.lower(): "family" for _, f in people}
    text = "; ".join(["Zed", *[f"{g} {f}" for g, f in people]])
    piece = Piece(text, lexicon)
    spans, edges = P.chains_of(piece)
    names = np.zeros(P.K, "float32")
    names[P.NAME] = 2.0
    model = {"w": np.stack([names, -names, names * 0]), "trans": np.zeros((P.K, P.K), "float32"), "skip": np.zeros((P.K, P.K), "float32")}
    chains = [[[0 if piece.classes[i] else 1] for i in range(*s)] for s in spans]
    got = P.items(piece, spans, P.posterior(model, chains, edges))
    assert [text[a:b] for a, b, k in got if k == P.NAME] == [f"{g} {f}" for g, f in people]


def test_field_holds_on_chains_of_any_length():
    """A long chain passed beside short ones has the labels that exact sums in double precision give."""
    import numpy as np

    rng = np.random.default_rng(4)
    n = P.BATCH_CELLS + 500
    model = {"w": np.vstack([rng.normal(size=(5, P.K)) * 3, np.zeros(P.K)]).astype("float32"), "trans": rng.normal(size=(P.K, P.K)).astype("float32"), "skip": np.zeros((P.K, P.K), "float32")}
    long = [[int(x)] for x in rng.integers(0, 5, n)]
    got = P.posterior(model, [[[0]], long, [[1], [2]]], [])
    assert [len(p) for p in got] == [1, n, 2] and np.allclose(got[1].sum(1), 1, atol=1e-4)
    part = P.posterior(model, [long[n - 60 :]], [])[0]
    assert np.allclose(got[1][-20:], part[-20:], atol=1e-3)


def test_every_mention_hears_of_a_clear_one():
    """Of twenty mentions only the first is clear; with skip edges all are, also the last."""
    import numpy as np

    clear, vague = np.zeros(P.K, "float32"), np.zeros(P.K, "float32")
    clear[P.NAME], vague[0] = 6.0, 0.1
    skip = np.full((P.K, P.K), -2.0, "float32") + 4 * np.eye(P.K, dtype="float32")
    model = {"w": np.stack([clear, vague, vague * 0]), "trans": np.zeros((P.K, P.K), "float32"), "skip": skip}
    chains = [[[0 if n == 0 else 1]] for n in range(20)]
    alone = P.posterior(model, chains, [])
    heard = P.posterior(model, chains, [(0, n, 0) for n in range(20)])
    assert all(p[0, P.NAME] < 0.2 for p in alone[1:]) and all(p[0, P.NAME] > 0.5 for p in heard)


def _people(n, given, family, rnd):
    forms = ["Reviewed-by: {}\nThe queue is shut.", "Thanks to {} for the trace!\n", "Please ask {} before touching the table.\r\n", "author: {}", "| {} | on call |\n"]
    decoys = ["The Grace Period ends. ", "Rose Tree nodes are shared. ", "public Envelope ScanShard() ", "See Street View tiles. "]
    return [(i, rnd.choice(decoys) * (i % 2) + rnd.choice(forms).format(f"{rnd.choice(given)} {rnd.choice(family)}"), "en", "x") for i in range(n)]


GIVEN, FAMILY = ["Amara", "Rurik", "Noor", "Otto", "Femke", "Zoë", "Rose", "Grace"], ["Quellmar", "Birkvane", "Corvessy", "Halvessen", "Ostrelin"]


def _known(spark, given=GIVEN, family=FAMILY):
    return spark.createDataFrame([(n, "given") for n in given] + [(n, "family") for n in family] + [(None, "given"), ("Otto", "given")], "name string, name_kind string")


def test_field_finds_names_that_no_lexicon_has(spark):
    """Held-out names: in documents that the field wasn't trained on, and of which no word is in the lexicon."""
    docs = spark.createDataFrame(_people(400, GIVEN, FAMILY, random.Random(10)), DOC)
    lexicon = {n.lower(): "given" for n in GIVEN} | {n.lower(): "family" for n in FAMILY}
    model = P.fit(docs, 400, spark.sparkContext.broadcast(lexicon))
    new = [f"{'Rose Tree nodes are shared. ' * (i % 2)}Reviewed-by: Zan{a} Thol{a}vik\nThe queue is shut." for i, a in enumerate("bdfgklmnprst")]
    found = P.read(model, [Piece(t, lexicon, model["common"]) for t in new])
    assert sum([t[a:b] for a, b, _ in f] == [t.split(": ")[1].split("\n")[0]] for t, f in zip(new, found)) >= 10
    out = {i["pii_value"] for r in P.redact(docs, _known(spark)).collect() for i in r["items"]}
    assert len(out) > 30 and not out & {"Grace Period", "Rose Tree", "Envelope ScanShard", "Street View"}


def test_lexicon_by_broadcast_and_by_join_are_the_same(spark):
    docs = spark.createDataFrame([*_people(150, GIVEN, FAMILY, random.Random(11)), (None, "Ask Amara Quellmar.", "en", "x"), (3, "al-Noor Birkvane, AMARA-ROSE Corvessy", "en", "x")], DOC)
    both = [sorted((r["doc_id"] or -1, r["redacted"]) for r in P.redact(docs, _known(spark), most_names=m).collect()) for m in (1000, 0)]
    assert both[0] == both[1] and (-1, "Ask [NAME].") in both[0]


def test_training_rows_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame(_people(90, GIVEN, FAMILY, random.Random(12)), DOC)
    lexicon = spark.sparkContext.broadcast({n.lower(): "given" for n in GIVEN} | {n.lower(): "family" for n in FAMILY})
    one, other = (P.fit(docs.repartition(n), 40, lexicon) for n in (1, 7))
    assert one["index"] == other["index"] and (one["w"] == other["w"]).all() and one["common"] == other["common"]


def test_names_are_learned_from_partners(spark):
    texts = ["Amara Thornwick", "Rurik Thornwick said", "Thornwick, Noor", "Otto Sweep", "Amara Sweep", "Vesna Quellmar", "Vesna Birkvane", "Vesna von Corvessy", "Ask Quellmar", "Thanks Otto. Thanks Amara", None, ""]
    docs = spark.createDataFrame([(i, t, "en", "x") for i, t in enumerate(texts)], DOC)
    got = dict(P.learned_names(docs, _known(spark)).collect())
    assert got["thornwick"] == "family" and got["vesna"] == "given" and not {"sweep", "ask", "thanks"} & got.keys() and got["rose"] == "given"
    assert P.learned_names(docs.where("false"), _known(spark).where("false")).count() == 0
