"""Known figures of the 42 sample documents; FOLIOSCOPE_SAMPLES names their folder, and
FOLIOSCOPE_CONFIG the site's configuration."""

import os

import pytest
from pyspark.sql import functions as F

from folioscope import cli
from folioscope.operators import citations as K
from folioscope.operators import graph as G
from folioscope.operators import procedures as P
from folioscope.operators import similarity as V
from folioscope.operators import structure as S
from folioscope.plans import modules as M

FOLDER, CONFIG = os.environ.get(cli.SAMPLES), os.environ.get(cli.CONFIG)
pytestmark = pytest.mark.skipif(not FOLDER or not CONFIG, reason="no sample documents are named")


@pytest.fixture(scope="module")
def inputs(spark):
    return cli.inputs_of(spark, FOLDER, CONFIG)


def test_documents_and_graph(inputs):
    assert (inputs.docs.count(), inputs.english.count()) == (42, 40)
    links = G.edges(inputs.english, inputs.english).cache()
    assert links.count() == 97
    assert {r["dst"] for r in G.broken_references(links).collect()} == {"SOP-CLN-099", "SOP-VAL-001"}
    assert G.orphans(inputs.english, links).count() == 2 and G.hubs(links).first()["in_degree"] == 24
    lengths = {r["length"]: r["count"] for r in G.cycles(links).groupBy("length").count().collect()}
    assert lengths == {2: 14, 3: 6, 4: 1, 8: 1, 9: 1}


def test_texts_and_citations(inputs):
    assert S.sections(inputs.docs).count() == 399
    cited = K.citations(inputs.english, inputs.register).cache()
    assert cited.count() == 51
    assert {r["status"]: r["count"] for r in cited.groupBy("status").count().collect()} == {"current": 44, "outdated": 7}


def test_pairs_and_scores(inputs):
    assert V.jaccard_pairs(V.shingle_sets(inputs.english), 0.2).count() == 9
    top = V.cosine_pairs(V.tf_idf(inputs.english), 0.75).agg(F.max("cosine")).first()[0]
    assert round(top, 3) == 0.988
    scores = M.m07_scorecard(inputs).table
    assert round(scores.agg(F.avg("overall")).first()[0], 1) == 6.1


def test_charts_translations_and_training(inputs):
    sums = P.chart_totals(P.flowcharts(inputs.english)).first()
    assert (sums["flowcharts"], sums["without_procedure"], sums["pages_replaced"], sums["decisions"]) == (34, 6, 68, 10)
    assert M.m12_multilang(inputs).table.count() == 4
