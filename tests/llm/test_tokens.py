"""Token operators against the public libraries."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from dielens.llm import bpe_automaton, fertility, token_counts, token_files

from .conftest import by_id


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_encode_and_decode(hard, plain, words):
    found = by_id(bpe_automaton.decode(bpe_automaton.encode(hard)))
    assert len(found) == len(plain) + 1
    for i, text in plain:
        ids = words.encode(text, add_special_tokens=False).ids
        assert found[i]["ids"] == ids, i
        assert found[i]["decoded"] == words.decode(ids, skip_special_tokens=False), i


def test_automaton_has_one_path_for_each_word(words):
    bpe = bpe_automaton.word_bpe("word_bpe_49k.json")
    rng = np.random.default_rng(1)
    made = ["".join(rng.choice(list("aehilnorst'.!x9éß"), n)) for n in rng.integers(1, 90, 3000)]
    flat, count = bpe.encode(made)
    ends = np.cumsum(count)
    for k, word in enumerate(made):
        assert flat[ends[k] - count[k] : ends[k]].tolist() == words.encode(word, add_special_tokens=False).ids, word


def test_marks_are_ordered_as_the_library_orders_them(words):
    bpe = bpe_automaton.word_bpe("word_bpe_49k.json")
    rng = np.random.default_rng(5)
    marks = [chr(c) for c in [0x9FE, 0x323, 0x9CD, 0x301, 0x307, 0x327, 0x1DF6, 0x8D3, 0x1ABF, 0xF71, 0x5B0, 0x64B]]
    made = ["a\u09fe\u0323", "a\u09fe\u09cd", "İ", "I\u0307", "E\u0301", "Å", "\u212b", "각", "\u1100\u1161\u11a8"]
    made += ["".join(rng.choice(["a", "E", "s", "o", *marks], n)) for n in rng.integers(1, 12, 20000)]
    flat, count = bpe.encode([w.lower() if w.isascii() else w for w in made])
    ends = np.cumsum(count)
    for k, word in enumerate(made):
        assert flat[ends[k] - count[k] : ends[k]].tolist() == words.encode(word, add_special_tokens=False).ids, ascii(word)


def test_counts(hard, plain, pieces):
    found = by_id(token_counts.count_tokens(hard, limit=300))
    for i, text in plain:
        n = len(pieces.encode(text))
        assert (found[i]["n_bytes"], found[i]["n_tokens"], found[i]["over_limit"]) == (len(text.encode()), n, n > 300)
    assert found[None]["n_tokens"] > 0


def test_merging_in_arrays_equals_merging_with_a_heap(pieces):
    bpe = token_counts.piece_bpe("piece_bpe_32k.model")
    rng = np.random.default_rng(2)
    made = [" " + "".join(rng.choice(list("aehilnorst日é🙂"), n)) for n in rng.integers(1, 130, 2000)]
    flat, count = bpe.merge(made)
    ends = np.cumsum(count)
    for k, word in enumerate(made):
        assert flat[ends[k] - count[k] : ends[k]].tolist() == pieces.encode(word[1:]), word


@pytest.mark.parametrize("by_bit", [True, False])
@pytest.mark.parametrize(("width", "n"), [(2, 1), (2, 1000), (4, 77)])
def test_planes_round_trip(by_bit, width, n):
    ids = np.random.default_rng(n).integers(0, 50_000, n)
    planes = token_files.to_planes(ids, width, by_bit)
    assert len(planes) == width * (8 if by_bit else 1)
    assert (token_files.from_planes(planes, n, width, by_bit) == ids).all()


@pytest.mark.parametrize("by_bit", [True, False])
def test_token_files(spark, hard, plain, words, tmp_path, by_bit):
    path = f"{tmp_path}/{by_bit}"
    token_files.write_tokens(hard, path, block_ids=64, chunk_ids=500, by_bit=by_bit)
    found = by_id(token_files.read_tokens(spark, path))
    start = found[None]["n_tokens"]  # a null id comes first
    assert found[None]["start"] == 0
    for i, text in plain:
        ids = np.array([*words.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (found[i]["start"], found[i]["n_tokens"]) == (start, len(ids))
        assert zlib.crc32(found[i]["ids"]) == zlib.crc32(ids.tobytes())
        start += len(ids)
    index = spark.read.parquet(f"{path}/index")
    assert index.count() == spark.read.parquet(f"{path}/chunks").count() > 5


def test_fertility_base_counts(hard, plain):
    import collections
    import re

    found = by_id(fertility.judge(fertility.measure(hard)))
    for i, text in plain:
        own = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        windows = collections.Counter(tuple(own[k : k + 8]) for k in range(len(own) - 7))
        hit = [False] * len(own)
        for k in range(len(own) - 7):
            if windows[tuple(own[k : k + 8])] > 1:
                hit[k : k + 8] = [True] * 8
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(own), sum(map(len, own)), dup, sum(hit)
        ), i
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        assert r["base_failed"] == (len(own) < 20 or 100 * sum(hit) > 30 * len(own))
        assert not (r["base_failed"] and r["kept"])


def test_fertility_measures(hard, plain, pieces):
    import collections
    import math

    found = by_id(fertility.measure(hard))
    for i, text in plain:
        ids = pieces.encode(text)
        counts = collections.Counter(ids)
        entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in counts.values()) if ids else 0
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["n_byte_tokens"] == sum(pieces.is_byte(x) for x in ids)
        assert found[i]["token_entropy"] == pytest.approx(entropy, abs=1e-9)


def test_bands_reject_what_the_vocabulary_does_not_fit(spark):
    odd = "".join(chr(0x1F300 + k % 200) + chr(0xE000 + k) + " " for k in range(400))
    rows = [(1, "the house and the garden " * 3 + "were found by many people in summer " * 2 + "near to the old river side"), (2, odd)]
    verdict = by_id(fertility.judge(fertility.measure(spark.createDataFrame(rows, "doc_id long, text string")), min_tokens=20))
    assert verdict[2]["byte_share"] > 0.8
    assert not verdict[2]["kept"]


def _drawn(letters, seed, n=200):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(3, 9))) for _ in range(n))


def test_bands_under_both_vocabularies(spark):
    import base64
    import random

    r = random.Random(7)
    junk = [
        "\n".join(base64.b64encode(r.randbytes(57)).decode() for _ in range(40)),
        _drawn("bcdfghjklmnpqrstvwxz", 1),
        _drawn("abcdefghijklmnopqrstuvwxyz", 2),
        " ".join(str(r.randint(0, 10 ** r.randint(2, 9))) for _ in range(200)),
        _drawn("αβγδεζηθικλμνξοπρστυφχψω", 3),
        _drawn("абвгдежзийклмнопрстуфхцчшщъыьэюя", 4),
        _drawn([chr(c) for c in range(0x4E00, 0x9FA6)], 5),
    ]
    # the first article of the declaration of human rights
    clean = [
        "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and "
        "should act towards one another in a spirit of brotherhood.",
        "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und "
        "sollen einander im Geist der Brüderlichkeit begegnen.",
        "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience "
        "et doivent agir les uns envers les autres dans un esprit de fraternité.",
        "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, "
        "deben comportarse fraternalmente los unos con los otros.",
        "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική "
        "και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны "
        "поступать в отношении друг друга в духе братства.",
        "يولد جميع الناس أحراراً متساوين في الكرامة والحقوق. وقد وهبوا عقلاً وضميراً وعليهم أن يعامل بعضهم بعضاً بروح "
        "الإخاء. لكل إنسان حق التمتع بكافة الحقوق والحريات الواردة في هذا الإعلان",
        "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है",
        "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 "
        "형제애의 정신으로 행동하여야 한다. 모든 사람은 인종, 피부색, 성, 언어, 종교 등 어떠한 종류의 차별도 없이 이 선언에 나와 있는 "
        "모든 권리와 자유를 누릴 자격이 있다.",
    ]
    rows = [(k, text) for k, text in enumerate(junk + clean)]
    measured = fertility.measure(spark.createDataFrame(rows, "doc_id long, text string"))
    found = by_id(fertility.judge(measured))
    assert [k for k in range(len(junk)) if found[k]["kept"]] == []
    assert not any(found[k]["base_failed"] for k in range(len(rows)))
    # the sentences are short: no text is too short for the bands here
    found = by_id(fertility.judge(measured, min_tokens=1))
    assert [k for k in range(len(junk), len(rows)) if not found[k]["kept"]] == []
    want = ["latin"] * 3 + ["none", "greek", "cyrillic", "east_asian"] + ["latin"] * 4
    want += ["greek", "cyrillic", "semitic", "indic", "east_asian"]
    assert [found[k]["script"] for k in range(len(rows))] == want


def test_second_vocabulary_counts_and_scripts(hard, plain):
    import base64
    import re

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    bpe = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = by_id(fertility.measure(hard))
    for i, text in plain:
        own = re.findall(r"[^\x20\x09-\x0D]+", text)
        if all(len(w) <= fertility.STRETCH for w in own):
            assert found[i]["n_multi_tokens"] == sum(len(bpe.encode_ordinary(" " + w)) for w in own), i
    assert {r["script"] for r in found.values()} <= set(fertility.SCRIPTS)


def test_scripts_by_code_point(spark):
    texts = ["ሰላም ለዓለም", "გამარჯობა", "Ελλάδα ἀρχή", "שלום", "ಕನ್ನಡ", "ไทย", "日本語 テスト", "한국어", "123 ... 🎉", "Tiếng Việt", "𠀀𠀁"]
    want = ["other", "other", "greek", "semitic", "indic", "other", "east_asian", "east_asian", "none", "latin", "east_asian"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = by_id(fertility.measure(rows))
    assert [found[k]["script"] for k in range(len(texts))] == want


def test_empty_tables(spark, nothing, tmp_path):
    assert bpe_automaton.decode(bpe_automaton.encode(nothing)).count() == 0
    assert token_counts.count_tokens(nothing).count() == 0
    assert fertility.judge(fertility.measure(nothing)).count() == 0
    token_files.write_tokens(nothing, f"{tmp_path}/none")
    assert token_files.read_tokens(spark, f"{tmp_path}/none").count() == 0


def test_repeated_rows_stay(spark):
    df = spark.createDataFrame([(1, "same text"), (1, "same text")], "doc_id long, text string")
    assert bpe_automaton.encode(df).count() == token_counts.count_tokens(df).count() == fertility.measure(df).count() == 2


def test_a_worker_holds_little_text_at_a_time():
    """Arrays are made for a megabyte of text, and the powers of names for no more than that needs."""
    import pyarrow as pa

    from dielens.llm.text import given_back, slices
    from dielens.llm.words import powers

    rows = pa.RecordBatch.from_pydict({"text": ["x" * 600_000] * 4 + ["y" * 2_500_000, None, "z"]})
    parts = list(slices(rows))
    assert [p.num_rows for p in parts] == [1, 1, 1, 1, 1, 2]
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([rows]))
    assert powers(3, 1000).base.nbytes <= 8 << 20
    assert list(powers(3, 4)) == [1, 3, 9, 27]
    assert list(given_back(iter([rows, rows]))) == [rows, rows]
