"""Encoding: the best segmentation, an exact round trip, and a stream that agrees with the whole."""

from __future__ import annotations

import os
import random

import pytest

from corpusloom.llm import pieces

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


def best_score(text, p):
    """The highest sum of scores over all segmentations."""
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - p.longest), end):
            found = p.table.get(text[start:end])
            if found:
                best[end] = max(best[end], best[start] + found[1])
        if text[end - 1] not in p.table:
            best[end] = max(best[end], best[end - 1] + p.unknown)
    return best[-1]


def score_of(ids, p):
    """Sum of the scores of ids; a run of byte pieces is as many unknown characters as it decodes to."""
    scores, decoder, total, run = dict(zip(p.ids, p.scores)), p.decoder(), 0.0, b""
    for i in ids:
        if i in scores:
            total += scores[i]
        else:
            run += decoder[i]
    return total + len(run.decode()) * p.unknown


def test_encoding_is_optimal_and_reversible(vocabulary):
    rng = random.Random(5)
    searcher, decoder = pieces.Searcher(vocabulary), vocabulary.decoder()
    texts = ["".join(rng.choice("the aindon  éß日▁\n\t🤖xq") for _ in range(rng.randint(0, 120))) for _ in range(300)]
    for text, ids in zip(texts, searcher.encode(texts)):
        assert pieces.decode_ids(ids, decoder, True) == text
        if text:
            assert score_of(ids, vocabulary) == pytest.approx(best_score(" " + text, vocabulary), rel=1e-12)


def test_stream_agrees_and_keeps_a_bounded_window(vocabulary):
    rng = random.Random(6)
    searcher = pieces.Searcher(vocabulary)
    text = "".join(rng.choice("theraindosl") for _ in range(20_000)) + " end"
    whole = searcher.encode([text])[0]
    assert pieces.encode_stream([" " + text], vocabulary) == whole
    stream, out, most = pieces.Stream(vocabulary), [], 0
    for c in " " + text:
        out += stream.feed(c)
        most = max(most, len(stream.best))
    assert out + stream.close() == whole
    assert most < 40 * vocabulary.longest


def test_scores_reach_the_librarys(vocabulary):
    """The library's search over the same pieces and scores never finds a better segmentation."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(pieces.MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    rng = random.Random(7)
    words = ["".join(rng.choice(["th", "er", "ion", "a", "s", "on", "é", "qu"]) for _ in range(rng.randint(1, 6))) for _ in range(500)]
    same = 0
    for word, ids in zip(words, pieces.Searcher(vocabulary).encode(words)):
        other = library.encode(word)
        assert score_of(ids, vocabulary) >= score_of(other, vocabulary)
        same += ids == other
    assert same > 450


def test_encode_and_decode_tables(spark, docs, repeated, nothing, texts):
    found = pieces.encode(docs, carry=["id", "key", "source"])
    assert found.columns == ["doc_id", "id", "key", "source", "n_tokens", "ids", "round_trip"]
    back = {r.doc_id: r for r in pieces.decode(found, text_col="decoded").collect()}
    for i, text in enumerate(texts):
        assert back[i].round_trip and back[i].decoded == (text or "") and back[i].n_tokens == len(back[i].ids)
    assert pieces.encode(repeated).count() == 2 * len(texts)
    assert pieces.encode(nothing).count() == 0
