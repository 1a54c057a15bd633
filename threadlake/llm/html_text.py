"""Main text of web pages by a conditional random field over leaf blocks.

A page is cut into the leaf blocks of its DOM.  Each block is described by the
tags and names (class, id, role) of its ancestors and by its text, the blocks of
a page form a chain, and Viterbi decoding labels each as article or not.  The
model is trained on labelled pages on the driver, once per process; its
weights, a few hundred numbers, go to the tasks with the function.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm.crf import Chain, train
from threadlake.llm.html_blocks import Block, Element, leaf_blocks
from threadlake.llm.labelled_pages import labelled_pages

SECTIONS = frozenset("article main nav aside header footer form section table ul ol dl figure blockquote".split())


def path_features(path: tuple[Element, ...]) -> list[str]:
    """What the ancestors say, whatever the text."""
    tags = [e.tag for e in path if e.tag not in ("html", "body", "head")]
    out = {f"in:{t}" for t in tags}
    out.add(f"parent:{tags[-1] if tags else '-'}")
    near = [t for t in tags if t in SECTIONS]
    out.add(f"section:{near[-1] if near else '-'}")
    out.add(f"outer:{near[0] if near else '-'}")
    names = {n for e in path for n in e.names}
    for name in names:
        # Stems, so that plurals and compounds share a weight.
        out.add(f"name:{name[:5]}")
    out.add("named" if names else "nameless")
    deepest = next((e for e in reversed(path) if e.names), None)
    if deepest is not None:
        out.update(f"deep:{n[:5]}" for n in deepest.names)
        out.add(f"deep tag:{deepest.tag}")
    return sorted(out)


def text_features(block: Block) -> list[str]:
    text = block.text
    words = text.count(" ") + 1
    raw = sum(map(len, block.parts))
    share = block.link_chars / raw if raw else 0.0
    return [
        f"words:{min(words.bit_length(), 7)}",
        f"links:{'none' if share == 0 else 'some' if share < 0.5 else 'most'}",
        f"end:{'stop' if text[-1] in '.!?:;' else 'open'}",
        *(["mark:copyright"] if "©" in text else []),
        f"sentences:{min(3, text.count('. ') + text.count('? ') + text.count('! '))}",
    ]


def features(block: Block) -> list[str]:
    return path_features(block.path) + text_features(block)


@lru_cache(maxsize=1)
def trained() -> Chain:
    """The model for the library's labelled pages."""
    chains, labels = [], []
    for page in labelled_pages():
        blocks = leaf_blocks(page)
        if blocks:
            chains.append([features(b) for b in blocks])
            labels.append([int(any(e.marked for e in b.path)) for b in blocks])
    return train(chains, labels)


class Extractor:
    """Main texts by a trained model; remembers the weights of paths it has seen."""

    #: Distinct ancestor paths remembered before starting anew.
    PATHS = 1 << 14

    def __init__(self, model: Chain):
        self._model = model
        self._paths: dict[tuple[Element, ...], float] = {}

    def _path_score(self, path: tuple[Element, ...]) -> float:
        score = self._paths.get(path)
        if score is None:
            if len(self._paths) >= self.PATHS:
                self._paths.clear()
            score = self._paths[path] = sum(self._model.weights.get(f, 0.0) for f in path_features(path))
        return score

    def text(self, page: str | None) -> str:
        blocks = leaf_blocks(page)
        weights = self._model.weights
        scores = [
            self._path_score(b.path) + sum(weights.get(f, 0.0) for f in text_features(b)) for b in blocks
        ]
        return "\n".join(b.text for b, label in zip(blocks, self._model.decode(scores)) if label)


def main_text(
    pages: DataFrame, model: Chain | None = None, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row.

    A null or empty page, or one without an article, has an empty text.  Rows
    are handled one by one, so repeated rows give equal rows and null ids or
    addresses stay null; an empty table gives no rows.  Other columns are not read.
    """
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(model)
        for batch in batches:
            texts = [extractor.text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select(
        F.col(page_id).cast("bigint").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.col(html).cast("string").alias("html"),
    ).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def html_query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return main_text(pages)
