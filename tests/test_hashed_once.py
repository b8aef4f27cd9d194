from rostrum.plans import registry, relations


def test_ledger_hashes_texts_once(spark, sf, monkeypatch):
    made = []
    real = relations.hashes
    monkeypatch.setattr(relations, "hashes", lambda comments: made.append(1) or real(comments))
    for name in ("J5_W7_N10_ledger", "W7_ledger_by_weight", "W7_ledger_by_significance"):
        made.clear()
        registry.QUERIES[name](spark, sf)
        assert len(made) == 1
