"""Names below many others on the path, and behind many class words, count."""

import time

from callscope.llm.html_text import block_vectors, leaf_blocks, marked


def test_names_below_many_and_behind_many():
    deep = "".join(f"<div class='wrap row col{'x' * n} grid'>" for n in range(20))
    many = "mt-4 px-2 lg:flex sm:grid md:block text-sm font-bold rounded shadow border"
    page = deep + f"<article><p>Text of it.</p></article><section class='{many} comments'><p>Text of it.</p></section><form><p>Text of it.</p></form><article class='{many} sidebar'><p>Text of it.</p></article>"
    blocks = leaf_blocks(page)
    assert [marked(b[0]) for b in blocks] == [True, False, False, False]
    assert ".comments" in tuple(blocks[1][0]) and ".sidebar" in tuple(blocks[3][0])
    x = block_vectors(blocks)[:, :128]
    assert len({row.tobytes() for row in x}) == 4
    assert (block_vectors([(tuple(b[0]), *b[1:]) for b in blocks]) == block_vectors(blocks)).all()


def test_depth_costs_no_more():
    began = time.process_time()
    blocks = leaf_blocks("<div class=a>word " * 50_000)
    block_vectors(blocks)
    assert len(blocks) == 50_000 and time.process_time() - began < 30
