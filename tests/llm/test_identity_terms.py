"""Long identity terms: no stem of theirs may carry a weight past the counterfactual swap."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import toxicity


def test_terms_and_forms_are_one_feature():
    for term, lang in toxicity._GROUP.items():
        at = toxicity.BUCKETS + toxicity._TERMS.index(term)
        assert toxicity.features([term])[0].tolist() == [at], (lang, term)
        for form in toxicity.FORMS.get(term, "").split():
            own = toxicity.features([form])[0]
            assert len(own) == 1 and own[0] >= toxicity.BUCKETS, form
    whole, stem = toxicity.features(["immigrants immigrant", "parlement"])
    assert whole.tolist() == [toxicity.BUCKETS + toxicity._TERMS.index("immigrants")] and len(stem) == 4


@pytest.mark.parametrize("term,mention", [("immigrants", "immigrant"), ("muslims", "muslim"), ("flüchtlinge", "flüchtling"), ("musulmanes", "musulmana")])
def test_long_terms_that_go_with_the_label(term, mention, spark):
    rng = np.random.default_rng(3)
    names = ["".join(chr(97 + x) for x in rng.integers(0, 26, 8)) for _ in range(400)]
    rows = [(i, f"the {term if i % 2 or i % 50 == 0 else names[i]} are {'awful' if i % 2 and i % 6 != 1 else 'nice'} here", i % 2) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    group = toxicity.IDENTITY[toxicity._GROUP[term]]
    other = group[(group.index(term) + 3) % len(group)]
    own, form, swap, bad = (model.score(f) for f in toxicity.features([f"the {term} are nice here", f"the {mention} are nice here", f"the {other} are nice here", "the awful are here"]))
    assert own == form and abs(own - swap) < 0.1 and own < 0.5 < bad, (own, form, swap, bad)
