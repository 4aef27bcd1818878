"""Licences of several paragraphs, or within a line, in longer texts."""

from ledgerline.llm import licenses


def test_paragraphs_and_sentences_inside_longer_texts():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.THRESHOLD)
    other = " ".join(f"word{i}" for i in range(600))
    for name, at in (("MIT", 2), ("Apache-2.0", 1), ("GPL-3.0", 1)):
        words = licenses.TEMPLATES[name][at].split()
        third = len(words) // 3
        paragraphs = "\n\n".join(" ".join(words[i : i + third + 1]) for i in range(0, len(words), third + 1))
        assert scanner.matches(f"{paragraphs}\n\n{other}").get(name) == 1.0
        assert scanner.matches(f"{other}\n\n{paragraphs}\n{other}").get(name) == 1.0
    assert scanner.matches(f"{other} Released under the MIT License. {other}") == {"MIT": 1.0}
    assert scanner.matches(other) == {} == scanner.matches("the " * 50_000)
