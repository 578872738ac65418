"""The training holds its sample and its weights without copies."""

import random
import tracemalloc

from packetloom.llm import langid

from .helpers import sentence


def test_training_holds_no_copies_of_its_weights():
    rng = random.Random(2)
    rows = [(sentence(rng, 60), f"lang{i % 12}") for i in range(120)]
    tracemalloc.start()
    model = langid.fit(rows, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    held = 2 * (1 << langid.BITS) * 12 * 8  # what the learner keeps a weight
    assert model.table.shape == (1 << langid.BITS, 12) and peak < 1.8 * held
