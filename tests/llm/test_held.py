"""What a worker holds between tasks."""

from public_tokenizers import path as tokenizer_path

from lodestar.llm.arrow import _release
from lodestar.llm.encoding import WordEncoder, load_tokenizer, word_encoder
from lodestar.llm.quality_model import quality_scores

TEXTS = ["It isn't the same word twice, word twice.", "", "naïve café 12 ½", "Жёлтый дом", "a\x01b"]


def test_memo_of_words_is_forgotten_between_tasks():
    path = str(tokenizer_path("word_bpe_49k.json"))
    library = load_tokenizer(path)
    expected = [library.encode(t, add_special_tokens=False).ids for t in TEXTS]
    encoder = word_encoder(path)
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode_batch(TEXTS)] == expected
        assert encoder.now
        _release(path)
        assert word_encoder(path) is encoder and not encoder.now and not encoder.old
    _release(None)
    assert word_encoder(path) is not encoder
    _release(None)


def test_common_words_stay_in_a_full_memo():
    path = str(tokenizer_path("word_bpe_49k.json"))
    encoder, asked = WordEncoder(path, limit=20), []
    fast = encoder.fast
    encoder.fast = lambda text: (asked.append(text), fast(text))[1]
    for k in range(13):  # some words stand in each text, the common ones in every sixth, and each has new ones
        text = " ".join([*(f"steady{c}" for c in "abcdefgh"), *(f"commonest{c}," for c in "abcdefghij" if k % 6 == 0), *(f"rare{c}{'x' * k}." for c in "klmnopq")])
        assert encoder.encode(text) == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert sum("commonesta" in a for a in asked) == 1 and len(encoder.now) <= 40
    others = [f"other{c}" for c in "abcdefghijklmnopqrstuvw"]
    for words in (others, others, others[:10] + [f"new{c}" for c in "abcdefghijklm"], others):  # most are other ones: a new memo begins, twice
        text = " ".join(words)
        assert encoder.encode(text) == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert "commonesta," not in encoder.now and sum("othera" + encoder.MARK in a for a in asked) == 1
    assert encoder.encode(" ") == [] and encoder.encode("") == []


def test_letters_that_leave_the_plain_ones_by_lower_case():
    encoder = WordEncoder(str(tokenizer_path("word_bpe_49k.json")))
    for text in ["Ⱥb, ȾȺ c", "(Ⱦx)", "x1Ⱥ", "İx, İ", "'Ⱥ 'sȺ"]:
        assert encoder.encode(text) == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_a_label_counts_once_however_often_its_document_stands(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    once = {r["doc_id"]: r["score"] for r in quality_scores(docs, labels).select("doc_id", "score").collect()}
    again = quality_scores(docs.union(docs.where("doc_id % 3 = 0")).union(docs.where("doc_id = 1")), labels).select("doc_id", "score").collect()
    assert len(again) > len(once) and all(once[r["doc_id"]] == r["score"] for r in again)
