import random

import public_tokenizers
from tokenizers import Tokenizer

from lodemap.llm import token_files


def test_segments_are_encoded_together_and_have_the_ids_that_each_has_alone():
    tokenizer = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    none = token_files._together(tokenizer)([])
    assert [len(x) for x in none] == [0, 0]
    calls, pick = [], random.Random(5)

    class Counted:
        def __getattr__(self, name):
            return getattr(tokenizer, name)

        def encode_batch_fast(self, texts, **given):
            calls.append(len(texts))
            return tokenizer.encode_batch_fast(texts, **given)

    letters = "aZé日😀́'’s12-_.,!<|> \n\t \x1c "
    odd = ["".join(pick.choice(letters) for _ in range(pick.randint(1, 9))) for _ in range(4_000)]
    plain = [f" word{i}" for i in range(4_000)] + [f" {x}" for x in odd] + [" <|endoftext|>", "<|endoftext|>", " ", " 's", "'s", " don't", " �"]
    segments = [*odd, *plain]
    pick.shuffle(segments)
    want = [tokenizer.encode(s, add_special_tokens=False).ids for s in segments]
    ids, lengths = token_files._together(Counted())(segments)
    assert lengths.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert sum(calls) < len(segments) * 0.7


def test_whole_texts_have_the_tokenizers_ids():
    path, pick = public_tokenizers.path(token_files.TOKENIZER), random.Random(6)
    tokenizer = Tokenizer.from_file(path)
    parts = [" the", " a", "\n", "\n\n", "  ", " é", " 日本", " 😀", "'s", " 12", " x-y", ".", " <|endoftext|>", "\t", " "]
    texts = ["".join(pick.choice(parts) for _ in range(200)) for _ in range(300)]
    ids, at = token_files._coder(path, True)(texts)
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
