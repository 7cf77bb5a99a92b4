"""Words with marks behind them: the tokenizer's own ids."""
import pyarrow as pa
import pytest


@pytest.mark.parametrize("file, words", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_marks_behind_a_word_are_encoded_by_themselves(file, words):
    """Ids equal the tokenizer's; words that differ only in trailing marks are merged by the tokenizer once."""
    import public_tokenizers
    from ledgerscope.llm import tokens
    encoder = tokens.Encoder(public_tokenizers.path(file), words)
    marks = ["", ".", ",", "###", ".***", "!?", "_", "<|", "|>", "'s", "'", "s'.", "',", "%%%'ll", "-", "--x", "é.", "1.", ".1", "…", "<|endoftext|>."]
    texts = [f"{a}{m} {b}{m}\n{a}{m}" for a in ("Word", "naïve", "it's", "x2y", "中文", "-", "9", "", "e\u0301") for b in ("the", "Wordy") for m in marks]
    texts += [".", "###", "...a", "a.b.", "<|endoftext|>", "\n.\n,", "a\n.b"]
    for text, ids in zip(texts, encoder.encode_all(pa.array(texts))):
        assert ids == encoder.whole(text), text
    calls, real = [], encoder.whole
    encoder.whole = lambda p: calls.append(p) or real(p)
    list(encoder.encode_all(pa.array([f"alpha{m}" for m in ("", "###", "$$$", ".***", "###.", "###")] + [f"beta{m}" for m in ("###", "$$$")])))
    assert sorted(calls) == sorted(set(calls)) and not any(c.strip(" #$.*") for c in calls)
