from recordloom.llm import toxicity


def test_sample_is_not_cut():
    assert (toxicity.POSITIVES, toxicity.UNLABELLED) == (6000, 12000)
