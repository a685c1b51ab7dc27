"""Words of the token store's encoder: taken apart in one go, and encoded as the whole tokenizer does."""

from array import array

from tessella.llm import tokenstore
from tessella.llm.queries import tokenizer_path


def test_words_are_encoded_as_by_the_whole_tokenizer():
    words = tokenstore.WordEncoder(tokenizer_path("word_bpe_49k.json"))
    texts = ["", " ", "  the Cat\x0b", "blé, blé. blé é, É.", "zqx, zqx zqx. ,a a,, .", "a\x1cb x\r\nthe", "<|endoftext|> X", "don't 12ab, 你好. 🙂,", "ß, ÿþ."] * 70
    want = [array("H", words.whole.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    assert words([t.encode() for t in texts]) == want
    assert words([t.encode() for t in reversed(texts)]) == want[::-1] and words([]) == []


def test_fresh_words_with_marks_take_what_is_known_of_their_letters():
    words = tokenstore.WordEncoder(tokenizer_path("word_bpe_49k.json"))
    words.kept = {"tokenizer": words.whole, "known": {}, "old": {}}
    (plain,), seen, tokenize = words([b"zqxwv"]), [], words.tokenize
    words.kept["old"], words.kept["known"] = words.kept["known"], {}
    words.tokenize = lambda w: seen.append(w) or tokenize(w)
    assert words([b"zqxwv,"]) == [plain + words.marks[ord(",")]] and not seen  # forgotten words still serve
