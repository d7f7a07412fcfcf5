"""Shared inputs of the tests in this folder."""

#: Texts that any operator has to take: null, empty, blank, no letters, ties, repeats, very long, odd code points.
ODD = [
    None, "", " \n\t ", "!!! ... 123", "a", "a b", "a b c", "the of and", "the of and", "\x00\x1f     \U0001f600", "é ﬁ İ ΣΣ",
    "word " * 30000, "x" * 70000, "<|endoftext|> it's <|endoftext|>b",
]
