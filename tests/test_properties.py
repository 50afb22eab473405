"""Properties of random inputs."""

from hypothesis import given, settings
from hypothesis import strategies as st

from joinery.kernels import chains, graph_repair, graph_search, string_repair, strings
from joinery.kernels.graphs import FormatError, Graph, parse

words = st.text("abc", max_size=11)


@given(words, st.booleans())
@settings(max_examples=150, deadline=None)
def test_strings(text, turned):
    exact = strings.solve(text, turned)
    assert strings.replay(text, exact.steps, turned) == exact.index
    assert strings.solve(text[::-1], turned).index == exact.index
    assert strings.solve(text, True).index <= strings.solve(text).index
    bound = string_repair.repair(text, turned)
    assert exact.index <= bound.bound == string_repair.replay(bound.certificate()) <= max(len(text) - 1, -1)


@given(st.text(max_size=30), st.booleans())
@settings(max_examples=150, deadline=None)
def test_any_symbols(text, turned):
    assert string_repair.replay(string_repair.repair(text, turned).certificate()) == string_repair.repair(text, turned).bound


@st.composite
def graphs_(draw):
    n = draw(st.integers(1, 6))
    pairs = [(i, j) for i in range(n) for j in range(i)]
    chosen = draw(st.lists(st.sampled_from(pairs), unique=True, max_size=8)) if pairs else []
    return Graph.of([draw(st.sampled_from("CN")) for _ in range(n)], [(i, j, draw(st.integers(1, 2))) for i, j in chosen])


@given(graphs_())
@settings(max_examples=150, deadline=None)
def test_graphs(graph):
    exact = graph_search.solve(graph)
    assert graph_search.replay(graph, exact.steps) == exact.index
    bound = graph_repair.repair(graph)
    assert graph_repair.replay(bound.certificate()) == bound.bound
    if graph.edges:
        assert chains.chain_length(len(graph.edges)) <= exact.index <= bound.bound <= len(graph.edges) - 1
    assert graph_search.solve(graph, compensate=True).index == exact.index - max(graph.components() - 1, 0)


@given(st.binary(max_size=120), st.sampled_from(["x.mol", "x"]))
@settings(max_examples=300, deadline=None)
def test_parsers_give_a_graph_or_say_why(content, path):
    try:
        assert parse(content, path).edges is not None
    except FormatError as e:
        assert str(e)
