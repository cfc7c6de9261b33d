import public_tokenizers
import pytest

WORDS = "the and of thnd reing ouer hane leaux schung osbo éan ère das ist und mit pour que".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(("", "", "s", "ly", "tion", ".", ",")) for _ in range(n))


@pytest.fixture(scope="session")
def path():
    return public_tokenizers.path


def twins(n):
    """Two words of n letters that are equal under any polynomial modulo 2**64, from n = 1,024 on at the latest."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return [word, word.translate({97: 98, 98: 97})]


@pytest.fixture(scope="session")
def odd():
    """Texts that must not crash anything: null, empty, blank, very long, repeated, without spaces, odd characters, words that poor hashes take for equal."""
    return [*twins(512), *twins(1024), *twins(2048), *twins(4096), None, "", " \n\t ", "word", "x" * 30_000, "the end\n" * 5_000, "a b c d e f g h i j", "a b c d e f g h i j", "   　x", "é \U0001f642 <|endoftext|> </s>", "\x00\x1c\x85 ok", "▁ ▁▁ a▁b"]
