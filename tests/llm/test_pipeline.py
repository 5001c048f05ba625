"""Every stage against a brute-force version on its own input."""

import corpus_pipeline
import test_bpe
import test_decontam
import test_passages
import test_quality

from riskflow.llm.common import read, stage
from riskflow.llm.decontam import shingle_set

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SF, "documents")
    inputs, columns = [docs], docs.columns
    for name, apply in corpus_pipeline.STAGES:
        inputs.append(stage(apply(spark, inputs[-1], SF), f"test-{name}"))
    assert all(d.columns == columns for d in inputs[:-1])
    raw, good, single, cut, clean = ({r.doc_id: r.text for r in d.collect()} for d in inputs[:-1])

    for i, text in raw.items():
        n, _, symbols, _, repeat = test_quality.brute(text)
        failed = n < 10 or 100 * repeat > 20 * n
        assert not (failed and i in good)
        if not failed and symbols == 0 and repeat == 0:
            assert i in good

    sets = {i: shingle_set(t.encode(), 5) for i, t in good.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert set(single) == {i for i in sets if find(i) == i} and len(single) < len(good)

    assert cut == test_passages.brute_stage(single)[0] != single

    items = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    leaked = {d for d, _ in test_decontam.brute(list(cut.items()), items)}
    assert set(clean) == set(cut) - leaked and leaked

    ids = {r.doc_id: list(r.ids) for r in inputs[-1].collect()}
    assert ids == {i: test_bpe.ORACLE.encode_ordinary(t) for i, t in clean.items()}
    assert corpus_pipeline.run(spark, SF).count() == len(ids)
