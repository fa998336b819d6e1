import re
import time
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomwork.llm import htmlblocks, ids, linededup, mixing, ordered, packing, pii, tokenfile, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, block int, score int, topic string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 2, "x") for i, t, s in rows], DOCS)


# toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    good, bad = "the quiet river runs past {} houses", "you stupid moron number {} go away"
    rows = [(k, (bad if k % 3 == 0 else good).format(k * 7919), "s") for k in range(300)] + [(1000, "", "s"), (1001, None, "s"), (1002, "x" * 200_000, "s")]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    return docs(spark, rows), labels


def test_toxicity_learns_from_rows_that_are_not_held_out(labelled):
    rows = {r["doc_id"]: r for r in toxicity.toxicity(*labelled).collect()}
    assert len(rows) == 303
    for k in range(300):
        assert rows[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0)
        assert rows[k]["predicted"] == int(k % 3 == 0)
        assert 0 <= rows[k]["score"] <= 1
    assert rows[1000]["score"] == rows[1001]["score"]


def test_toxicity_drops_and_keeps(labelled, spark):
    kept = toxicity.without_toxic(*labelled)
    assert kept.columns == labelled[0].columns
    assert {r["doc_id"] for r in kept.where("doc_id < 300").collect()} == {k for k in range(300) if k % 3}
    one_kind = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert toxicity.without_toxic(labelled[0], one_kind).count() == 303
    assert toxicity.toxicity(labelled[0].limit(0), labelled[1]).count() == 0
    assert toxicity.toxicity(labelled[0], labelled[1].limit(0)).select("score").distinct().count() == 1


def test_toxicity_fits_every_gram_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 9000, raising=False)
    rng = np.random.default_rng(9)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(n))
    rows = [(k, words(700) + (" you moron " if k % 2 else " quiet river "), "s") for k in range(12)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows), labels)
    for _, text, _ in rows:
        at = toxicity.grams(text)
        assert len(at) > 4000
        assert (model.weight[at[model.ratio[at] != 0]] != 0).mean() > 0.99
        assert (model.score(text) >= 0.5) == (text.endswith(" you moron "))


# line dedup


def test_line_dedup(spark):
    rows = [(k, f"Menu\nown line {k}\n\n Menu \nshared", "a" if k < 20 else "b") for k in range(23)]
    rows += [(100, "Menu\nshared", "a"), (101, None, "a"), (102, "", "a"), (103, "Menu\nx", None)]
    found = {r["doc_id"]: r for r in linededup.without_boilerplate(docs(spark, rows), added=True).collect()}
    assert found[3]["text"] == "own line 3\n" and found[3]["n_dropped"] == 3 and found[3]["n_lines"] == 5
    assert found[21]["text"] == rows[21][1]  # too few pages of host b
    assert found[100]["text"] == "" and found[100]["n_dropped"] == 2  # nothing of its own
    assert found[101]["text"] is None and found[102]["text"] == "" and found[103]["text"] == "Menu\nx"
    assert linededup.without_boilerplate(docs(spark, [])).count() == 0


def test_line_dedup_without_broadcast(spark, monkeypatch):
    rows = [(k, f"Menu\nown {k}", "a") for k in range(9)] + [(20 + k, f"Top\nown {k}", None) for k in range(9)] + [(40, "Menu\nx", "b"), (41, None, "a"), (42, None, None)]
    want = sorted(map(repr, linededup.without_boilerplate(docs(spark, rows)).collect()))
    monkeypatch.setattr(linededup, "BROADCAST_LINES", 0)
    for size in (2**20, 10):  # hosts in one part, and in many
        monkeypatch.setattr(linededup, "PART_BYTES", size)
        assert sorted(map(repr, linededup.without_boilerplate(docs(spark, rows)).collect())) == want


def test_line_dedup_counts_copies_of_a_page_once(spark):
    clash = "doc_id long, text string, source string, host string, frame string, line string, met string, row string, n_lines string"
    rows = [(k, "one text\nof many copies", "a") for k in range(50)] + [(100 + k, f"Menu\nown {k}", "a") for k in range(6)]
    rows += [(200, "Menu\n" + "x" * 300_000, "a"), (200, "Menu\n" + "x" * 300_000, "a")]
    df = spark.createDataFrame([(*r, "1", "2", "3", "4", "5", "6") for r in rows], clash)
    found = linededup.without_boilerplate(df, added=True)
    by = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == len(rows) and by[3]["text"] == rows[3][1] and by[3]["row"] == "5"
    assert by[101]["text"] == "own 1" and by[200]["text"] == "x" * 300_000 and by[200]["n_lines"] == 2
    assert linededup.without_boilerplate(df).columns == df.columns


def test_line_dedup_as_its_sql_says(spark):
    import duckdb

    from loomwork.llm import queries

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(map(str, con.execute(queries.ORACLES["op6_line_dedup"]).fetchall()))
    assert sorted(str(tuple(r)) for r in queries.op6_line_dedup(spark, "/root/testdata/sf0.001").collect()) == want


# mixing


def test_mixing_without_ids_and_with_clashing_names(spark):
    rows = [("w " * k, "en", "s", "t", 1.0, "x", 2) for k in range(1, 200)] * 2
    df = spark.createDataFrame(rows, "text string, lang string, source string, topic string, tokens double, row string, number int")
    out = mixing.mixed(df, added=True)
    assert sorted(out.columns) == sorted([*df.columns, "probability"]) and 0 < out.count() < 398
    assert mixing.mixed(df).columns == df.columns
    assert all(r["count"] % 2 == 0 for r in mixing.mixed(df).groupBy("text").count().collect())


def test_toxicity_keeps_a_column_named_score(labelled, spark):
    df, labels = labelled
    kept = toxicity.without_toxic(df, labels)
    assert kept.select("score").distinct().collect()[0][0] == 2


def test_toxicity_on_the_given_labels(spark):
    sf = "/root/testdata/sf0.1"
    found = toxicity.toxicity(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    rows = found.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("predicted", "toxic").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    caught = [r["predicted"] for r in rows if r["toxic"]]
    assert right / len(rows) > 0.93 and sum(caught) / len(caught) > 0.55


def test_raking_meets_the_targets(spark):
    cells = spark.createDataFrame(
        [(s, l, t, float(n)) for s, l, t, n in [("a", "en", "x", 900), ("a", "fr", "y", 50), ("b", "en", "y", 100), ("b", "fr", "x", 30), ("a", "en", "y", 70), ("b", "en", "x", 60)]],
        "source string, lang string, topic string, tokens double",
    )
    targets = {d: mixing.shares(cells, d, mixing.POWER[d]) for d in mixing.DIMENSIONS}
    raked = mixing.rake(cells, targets)
    assert raked.error < 1e-6
    for d in mixing.DIMENSIONS:
        want = {r[d]: r["share"] for r in targets[d].collect()}
        got = {r[d]: r["w"] for r in raked.cells.groupBy(d).agg({"weight": "sum"}).withColumnRenamed("sum(weight)", "w").collect()}
        assert got == pytest.approx(want, abs=1e-5)


def test_mixing_draws_near_the_budget(spark):
    rows = [(k, "word " * (20 + k % 50), f"s{0 if k % 3 else k % 7}") for k in range(3000)] + [(None, "no id", None), (None, None, "s1")]
    df = docs(spark, rows)
    out = mixing.mixed(df, keep=0.6, added=True)
    total = df.select(mixing.tokens(df["text"]).alias("t")).agg({"t": "sum"}).first()[0]
    drawn = out.agg({"tokens": "sum"}).first()[0]
    assert abs(drawn / total - 0.6) < 0.05
    assert mixing.mixed(df).columns == df.columns
    assert sorted(map(str, mixing.mixed(df).collect())) == sorted(map(str, mixing.mixed(df).collect()))
    assert mixing.mixed(df.limit(0)).count() == 0


# personal data


def naive(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            fits = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}
            if fits[kind]:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_plain_identifiers_as_the_patterns_say():
    rng = np.random.default_rng(5)
    letters = np.array(list("a1@.+%-_ 5()Z:é4"))
    for _ in range(20_000):
        text = "".join(rng.choice(letters, rng.integers(0, 40)))
        assert pii.plain(text) == naive(text)
    for text in ("4111 1111 1111 1111", "a@b.c_d@e.f", "1.2.3.4.5", "+1 (555) 010-9999 x", "999.1.1.1", "a" * 100_000):
        assert pii.plain(text) == naive(text) if len(text) < 1000 else pii.plain(text) == []


@pytest.mark.parametrize("text, kind, span", [
    ("mail john [at] example [dot] com now", "email", "john [at] example [dot] com"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("x ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("call plus four nine one five five five one two three four five six ok", "phone", "plus four nine one five five five one two three four five six"),
    ("ip one nine two dot one six eight dot one dot one end", "ip", "one nine two dot one six eight dot one dot one"),
    ("+٤٩ 155 5123456", "phone", "+٤٩ 155 5123456"),
    ("to 𝗃𝗈𝗁𝗇@𝖾𝗑𝖺𝗆𝗉𝗅𝖾.𝖼𝗈𝗆 now", "email", "𝗃𝗈𝗁𝗇@𝖾𝗑𝖺𝗆𝗉𝗅𝖾.𝖼𝗈𝗆"),
    ("ⓙⓞⓗⓝ@example.com", "email", "ⓙⓞⓗⓝ@example.com"),
    ("jօhn@example.cօm", "email", "jօhn@example.cօm"),
    ("x \u13a0\u13aa\u13b7@example.com", "email", "\u13a0\u13aa\u13b7@example.com"),
])
def test_disguises(text, kind, span):
    (found,) = pii.disguised(text, pii.plain(text))
    assert found[0] == kind and text[found[1] : found[2]] == span


@pytest.mark.parametrize("text", ["meet at example.com", "a point at noon dot we go", "one two", "", "one of the two or three", "straße naïve œuvre"])
def test_no_disguise(text):
    assert pii.disguised(text, pii.plain(text)) == []


@pytest.mark.parametrize("text, kind, span", [
    ("at 192[.]168[.]1[.]20 now", "ip", "192[.]168[.]1[.]20"),
    ("at 192 dot 168 dot 1 dot 20 now", "ip", "192 dot 168 dot 1 dot 20"),
    ("one nine two [dot] 168 [dot] 1 [dot] two zero", "ip", "one nine two [dot] 168 [dot] 1 [dot] two zero"),
    ("call +1 555 123 four five six 7 now", "phone", "+1 555 123 four five six 7"),
    ("card 4111 1111 1111 111 one", "card", "4111 1111 1111 111 one"),
    ("mail john.smith @ example.com", "email", "john.smith @ example.com"),
    ("mail john@mail.example [dot] com", "email", "john@mail.example [dot] com"),
    ("card ４１１１ １１１１ １１１１ １１１１ one of", "card", "４１１１ １１１１ １１１１ １１１１"),
])
def test_disguises_of_digits_and_signs(text, kind, span):
    (found,) = pii.disguised(text, pii.plain(text))
    assert found[0] == kind and text[found[1] : found[2]] == span


def test_personal_data_rows(spark):
    rows = [(1, "a@b.co and 1.2.3.4", "s"), (2, None, "s"), (None, "", "s"), (1, "a@b.co and 1.2.3.4", "s"), (3, "j [at] b [dot] com", "s")]
    found = pii.digest(pii.personal_data(docs(spark, rows))).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == 5 and by[1]["spans"] == "email:0:6,ip:11:18" and by[1]["n_email"] == by[1]["n_ip"] == 1
    assert by[3]["n_email"] == 0 and by[3]["spans"] == "email:0:18" and by[2]["spans"] == ""
    assert pii.personal_data(docs(spark, [])).count() == 0


# ids, packing and files


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(ids.default_tokenizer())


def test_pieces_give_the_ids_of_the_whole(tokenizer):
    rng = np.random.default_rng(6)
    letters = np.array(list("ab é.,!'\n\t 12²ж(-_ ​\r x"))
    texts = ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(8000)]
    texts += ["", " ", "<|endoftext|> x<|endoftext|>", "don't 's", "word " * 1000, "foo.\n\nBar  baz\n"]
    enc = ids.Encoder(ids.default_tokenizer())
    for text, got in zip(texts, enc.ids(texts), strict=True):
        assert tokenizer.encode(text, add_special_tokens=False).ids == got.tolist(), repr(text)


def test_added_tokens_in_a_text_as_the_library_has_them(tokenizer):
    rng = np.random.default_rng(8)
    added = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
    parts = [*added, *added, "a", " b", "c ", "  ", "\n", "'s", "<|endof", "text|>", "<", "é", "ж", " \t", "12", "."]
    texts = ["".join(rng.choice(parts, rng.integers(0, 9))) for _ in range(4000)] + [t for x in added for t in (x, x + x, " " + x, x + " ", f"a{x}", f"{x}a", f"don{x}'t")]
    for text, got in zip(texts, ids.Encoder(ids.default_tokenizer()).ids(texts), strict=True):
        assert tokenizer.encode(text, add_special_tokens=False).ids == got.tolist(), repr(text)
    plain = ids.Encoder(ids.default_tokenizer(), plain=True).ids(texts)
    numbers = [tokenizer.token_to_id(x) for x in added]
    assert not any(n in ids_.tolist() for ids_ in plain for n in numbers)


def test_pieces_met_again_are_remembered(tokenizer, monkeypatch):
    monkeypatch.setattr(ids, "REMEMBERED", 200)
    rng = np.random.default_rng(9)
    new = lambda: "".join(rng.choice(list("abcdeé "), 6))
    batches = [["der Hund läuft " + " ".join(new() for _ in range(60)), "the dog runs, 12 times " + new()] for _ in range(20)]
    enc = ids.Encoder(ids.default_tokenizer())
    learn, learnt = enc._learn, []
    monkeypatch.setattr(enc, "_learn", lambda: (learnt.extend(list(enc._codes)[len(enc._start) :]), learn()))
    for batch in batches:
        for text, got in zip(batch, enc.ids(batch), strict=True):
            assert tokenizer.encode(text, add_special_tokens=False).ids == got.tolist(), repr(text)
        assert len(enc._codes) < 500
    assert learnt.count(" Hund") == learnt.count(" dog") == 1


def test_each_distinct_piece_of_a_batch_is_looked_up_once(tokenizer):
    enc, seen = ids.Encoder(ids.default_tokenizer()), []

    class Counted(type(enc._codes)):
        def get(self, piece, *other):
            seen.append(piece)
            return super().get(piece, *other)

        def __getitem__(self, piece):
            seen.append(piece)
            return super().__getitem__(piece)

    enc._codes = Counted()
    texts = ["El año pasado. The dog runs, " * 400, "the dog's tail. " * 300]
    for text, got in zip(texts, enc.ids(texts), strict=True):
        assert tokenizer.encode(text, add_special_tokens=False).ids == got.tolist()
    assert 8 <= len(seen) < 20


def test_pieces_know_their_tokens_and_ends_of_sentences(tokenizer, monkeypatch):
    rng = np.random.default_rng(10)
    parts = ["a", " b", "é", "ÿ", "ɏ", "ɐ", "×", "÷", "\x80", "ж", "'s", ".", "!", "…", "。", ".”", " ", "\n", "\t", "\x85", "\x1c", "7"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(6000)] + ["<|endoftext|>. a", "a. b", "a.", "", "b"]
    for most in (9, 2**22):
        monkeypatch.setattr(ids, "AT_A_TIME", most, raising=False)
        for text, (found, sizes, ends) in zip(texts, ids.Encoder(ids.default_tokenizer()).encode(texts), strict=True):
            assert tokenizer.encode(text, add_special_tokens=False).ids == found.tolist(), repr(text)
            assert sizes.sum() == len(found) and len(sizes) == len(ends) and ends.dtype == bool
            for at in np.cumsum(sizes)[ends]:
                assert tokenizer.decode(found[:at].tolist(), skip_special_tokens=False).endswith(ids.SENTENCE_ENDS), repr(text)
    _, sizes, ends = next(iter(ids.Encoder(ids.default_tokenizer()).encode(["Él dijo: 3. Y más!"])))
    assert ends.tolist() == [False, False, True, False, False, True] and len(sizes) == 6


def least_cost(place, penalty, window):
    best = {0: 0}
    for j in range(1, len(place)):
        best[j] = min(best[i] + window - (place[j] - place[i]) + penalty[j] for i in range(j) if place[j] - place[i] <= window)
    return best[len(place) - 1]


def test_cuts_cost_least():
    rng = np.random.default_rng(7)
    for _ in range(300):
        place = np.cumsum(np.r_[0, rng.integers(1, 9, rng.integers(1, 25))])
        penalty = rng.integers(0, 6, len(place))
        chosen = packing.cuts(place, penalty, window=10)
        assert chosen[0] == 0 and chosen[-1] == len(place) - 1 and (np.diff(place[chosen]) <= 10).all()
        cost = sum(10 - np.diff(place[chosen])) + penalty[chosen[1:]].sum()
        assert cost == least_cost(place.tolist(), penalty.tolist(), 10)


def test_packing_keeps_every_id_once(spark, tokenizer):
    rows = [(k, f"Sentence number {k}. " * (1 + k * 37 % 400), "s") for k in range(60)] + [(900, None, "s"), (901, "", "s"), (902, "x1" * 9000, "s"), (None, "lost", "s")]
    found = packing.packed(docs(spark, rows)).collect()
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == {r[0] for r in rows if r[0] is not None}
    for doc_id, text, _ in rows[:-1]:
        whole = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(whole)
            assert r["ids_crc32"] == zlib.crc32(whole[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(whole)
    windows = {}
    for r in found:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    used = sum(r["length"] for r in found)
    assert used / (2048 * len(windows)) > 0.9
    assert packing.packed(docs(spark, [])).count() == 0


def test_packing_does_not_depend_on_the_spacing_of_ids(spark, monkeypatch):
    text = lambda k: f"Sentence number {k}. " * (1 + k % 9)
    packs = {}
    for size in (2**20, 4000):
        monkeypatch.setattr(packing, "BLOCK_BYTES", size, raising=False)
        for name, of in (("near", lambda k: k), ("far", lambda k: k * 2**50 - 2**57)):
            found = packing.packed(docs(spark, [(of(k), text(k), "s") for k in range(256)])).collect()
            by_id = {of(k): k for k in range(256)}
            packs[size, name] = sorted((by_id[r["doc_id"]], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in found)
        assert packs[size, "near"] == packs[size, "far"]
        assert sum(p[2] for p in packs[size, "far"]) == sum(r["doc_tokens"] for r in found if r["start"] == 0)
    whole = packs[2**20, "far"]
    assert sum(p[2] for p in whole) / (2048 * len({p[3] for p in whole})) > 0.8


def test_blocks_grow_where_so_many_are_too_few(spark, monkeypatch):
    monkeypatch.setattr(ordered, "MOST_BLOCKS", 7)
    rows, n = ordered.identified_by_size(docs(spark, [(k * 3, "x" * 99, "s") for k in range(700)]), 100)
    found = sorted((r["doc_id"], r["block"]) for r in rows.collect())
    assert n <= 8 and len(found) == 700 and found[0][1] == 0
    assert [b for _, b in found] == sorted(b for _, b in found) and {b for _, b in found} == set(range(n))


def test_bit_packing_round_trip():
    rng = np.random.default_rng(8)
    for width in (1, 3, 7, 13, 16, 17, 20):
        values = rng.integers(0, 2**width, 10_000).astype(np.uint32)
        assert (tokenfile.unpack(tokenfile.pack(values, width), len(values), width) == values).all()
        one = tokenfile.Image(tokenfile.image([(7, values[:5000]), (-1, values[5000:5000]), (9, values[5000:])], width))
        assert one.doc_ids.tolist() == [7, -1, 9] and (one.document(2) == values[5000:]).all() and not len(one.document(1))
        assert (one.ids(4000, 9001) == values[4000:9001]).all()
    assert tokenfile.width_of(50_257) == 16 and tokenfile.width_of(2) == 1 and tokenfile.width_of(1) == 1


def test_token_files(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(tokenfile, "IMAGE", 300)
    rows = [(k * 3, f"text {k} " * (k % 90), "s") for k in range(700)] + [(5000, None, "s"), (None, "x", "s")]
    found = {r["doc_id"]: r for r in tokenfile.token_files(docs(spark, rows)).collect()}
    at = 0
    for doc_id, text, _ in sorted(rows[:-1]):
        whole = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (found[doc_id]["start"], found[doc_id]["n_tokens"]) == (at, len(whole))
        assert found[doc_id]["ids_crc32"] == zlib.crc32(whole.tobytes())
        at += len(whole)
    assert len(found) == 701
    assert tokenfile.token_files(docs(spark, [])).count() == 0


# pages


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1><p>A tagline that is long enough to mislead.</p></header>
<div class="cookie-notice"><p>We use cookies to make this site work, please accept all of them now.</p></div>
<div class="sidebar"><ul><li><a href=x>One<li><a href=y>Two</ul></div><article><header><h1>Title &amp; more</h1></header><p>Hello <a href=z>world</a> of
 text.<p>Short.<form><label>Mail</label><button>Go</button></form><div class="advert">Buy this thing now</div><ul><li>first item<li>second</ul>
<aside>Aside words</aside><p>End &eacute;&nbsp;x < y<br>z</p></article><section id="comments"><article class="comment"><p>Great post, I loved it so much, really did.</p></article>
</section><footer>(c) foo</footer><script>if(a<b){x="</p>"}</script></body></html>"""


def test_main_text_of_a_page():
    assert htmlblocks.article(PAGE) == "Title & more\nHello world of text.\nShort.\nfirst item\nsecond\nEnd é x < y z"


@pytest.mark.parametrize("page, text", [
    ("<p>{}</p><p>The last paragraph of this page has eleven words in it.</p>", "{}\nThe last paragraph of this page has eleven words in it."),
    ("<body><p>Short page.</p></body>", "Short page."),
    ("<body><h1>Hi</h1></body>", "Hi"),
    ("<article><p>x</p><div class='related-work'>Work.</div><p class='share-price'>9</p><div class='related-posts'>no</div></article>", "x\nWork.\n9"),
    ("<article><p>a</p><xmp>b</xmp><p><math><mi>c</mi></math></p></article>", "a\nb\nc"),
    ("<ul><li><a href=a>Home</a></ul><h1>T</h1><p>{}</p><p>Short.</p><div><a href=x>next page</a></div><div>foot note</div>", "T\n{}\nShort."),
])
def test_main_text_of_small_pages(page, text):
    long = " ".join(["word"] * 60)
    assert htmlblocks.article(page.format(long)) == text.format(long)


TITLED = "<article><h1>Title of the article</h1><p><a>By Some Author</a></p><p>{0}</p></article>"


@pytest.mark.parametrize("page, text", [
    (TITLED, "Title of the article\nBy Some Author\n{0}"),
    ("<main><p>{0}</p><ul><li><a>Source one</a></li></ul><p>{0}</p></main>", "{0}\nSource one\n{0}"),
    ("<body><nav><a>Home</a></nav><p>{0}</p></body>", "{0}"),
    ("<p>{0}</p><p><a>Read the full report</a></p><p>Here the page says fourteen words more, so that it has an ending today.</p>",
     "{0}\nHere the page says fourteen words more, so that it has an ending today."),
    ("<article><p>{0}</p><p><a>A paragraph that is one link.</a></p><figcaption>Photo by <a>A B C</a></figcaption></article>", "{0}\nA paragraph that is one link.\nPhoto by A B C"),
    ("<article><table><tr><td><a>One</a><td>2<td>3</table></article>", "One\n2\n3"),
    ("<div id=content class='post-12 has-sidebar'><p>{0}</p><p>Short.</p></div>", "{0}\nShort."),
    ("<div class=header-image-story><p>{0}</p></div><div class=share-holder><p>{0}</p></div><div class=copyright-law><p>{0}</p></div>", "{0}\n{0}\n{0}"),
    ("<div class=site-header>My site</div><p>{0}</p><div>Copyright 2020 A. B. All rights reserved.</div>", "{0}"),
    ("<div class='page-footer wide'>{0}</div><p>{0}</p>", "{0}"),
])
def test_linked_neighbours_cost_no_text(page, text):
    long = " ".join(["word"] * 60)
    assert htmlblocks.article(page.format(long)) == text.format(long)


def test_pages_without_article_marks_lose_no_text():
    """Blocks of 20 words or more with few links stay, whatever stands around them; named frames and lists of links go."""
    rng = np.random.default_rng(11)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    for _ in range(200):
        page, want, gone = ["<body>"], [], []
        for _ in range(rng.integers(3, 12)):
            kind = rng.integers(0, 6)
            text = words(int(rng.integers(20, 200)))
            if kind <= 2:
                page.append(f"<{['p', 'div', 'blockquote'][kind]}>{text}</{['p', 'div', 'blockquote'][kind]}>")
                want.append(text)
            elif kind == 3:
                page.append(f"<p>{text} <a href=x>{words(4)}</a> end</p>")
                want.append(text)
            elif kind == 4:
                links = [words(2) for _ in range(4)]
                page.append("<ul>" + "".join(f"<li><a href=y>{x}</a>" for x in links) + "</ul>")
                gone += links[1:3]
            else:
                page.append(f"<div class='{rng.choice(['sidebar', 'main-nav', 'ad', 'cookie-banner', 'comment-list'])}'>{text}</div>")
                gone.append(text)
        found = htmlblocks.article("".join(page)).split("\n")
        assert all(any(f.startswith(w) for f in found) for w in want)
        assert not set(found) & set(gone)


def test_many_unclosed_tags_take_linear_time():
    began = time.perf_counter()
    assert htmlblocks.article("<article>" + "<b>" * 50_000 + "x" + "</i>" * 50_000) == "x"
    assert time.perf_counter() - began < 5


def test_main_text_rows(spark):
    rows = [(1, "u", PAGE, 0), (2, None, None, 0), (3, "u", "", 0), (3, "u", "<div><p" * 1000, 0), (None, "v", "no tags, yet enough words in a row to be called a text of its own", 0)]
    found = htmlblocks.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(found) == 5 and found[1]["text"] == "" and found[2]["n_chars"] == 0
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert htmlblocks.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_disguised_addresses_as_one_pattern_finds_them():
    """The matching in steps against the pattern of the whole, on random texts."""
    whole = re.compile(rf"{pii._NAMES.pattern}{pii._SIGN.pattern}{pii._LABELS.pattern}", re.IGNORECASE)
    rng = np.random.default_rng(21)
    parts = ["a", "john", " ", " ", ".", " dot ", "[dot]", " at ", "[at]", "(@)", " @ ", "com", "-", "_", "%", "x.y", "@", " (dot) ", "\n", "at", "dot"]
    for _ in range(6000):
        text = "".join(rng.choice(parts, rng.integers(1, 14)))
        if re.search(r"dot[\])]?\s*[\[(]?dot", text):  # which of them is a name is anyone's guess
            continue
        assert list(pii._addresses(text)) == [m.span() for m in whole.finditer(text)], repr(text)


@pytest.mark.parametrize("text", ["a dot " * 60_000, "a at " * 60_000, "a.b" * 100_000 + " at", " " * 300_000 + "at", "x@y dot " * 40_000, "(at" * 100_000, "one two " * 50_000 + "[dot]"])
def test_disguises_take_linear_time(text):
    began = time.perf_counter()
    pii.disguised(text, pii.plain(text))
    assert time.perf_counter() - began < 15
