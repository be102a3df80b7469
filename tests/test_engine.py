from stemma.engine import Engine


def test_engine(spark, data):
    e = Engine(spark, data)
    v = e.search("prayer and the image of god")
    assert v.carrying_all_terms <= v.listed and v.counted <= v.listed
    assert e.search("zzyzx").listed == 0 and e.gap("zzyzx qqqq")["absent"] == ["zzyzx", "qqqq"]
    assert e.hits("prayer", limit=3).count() <= 3
    none = e.density("zzzzyyyyxxxx")
    assert none["nodes"] == [] and none["notices"] == 0
    some = e.density("prayer")
    assert 0 <= some["notices"] <= some["indexed"] and some["parameters"]["max_nodes"] == 8
    one = e.records.first()["notice_id"]
    assert e.record(one).count() == 1
    assert e.vocabulary().count() and e.stats().count() and e.coverage().where("dim = 'all'").count() == 1
    assert e.neighborhood("prayer").count() <= 50 and e.primary().columns == ["notice_id", "title", "year"]
    older = e.search("prayer", until=1990)
    assert older.listed <= e.search("prayer").listed
