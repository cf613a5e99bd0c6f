"""Query modules of this subpackage."""

MODULES = [
    "lodewell.llm.neighbours",
    "lodewell.llm.pieces",
    "lodewell.llm.ranking",
    "lodewell.llm.bpe",
    "lodewell.llm.generated",
    "lodewell.llm.credentials",
    "lodewell.llm.leaks",
    "lodewell.llm.abuse",
    "lodewell.llm.syntax",
]
