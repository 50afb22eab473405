"""What pathway documents and certificates say, read by a schema and counted with built-in functions only.

A document that does not parse gives nulls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRING_PATHWAY = "file_graph array<struct<Fragments:array<string>,Positions:array<int>>>, remnant array<struct<Fragments:array<string>,Positions:array<int>>>, duplicates array<struct<Left:array<int>,Right:array<int>>>"
_DRAWN = "array<struct<Vertices:array<int>,Edges:array<array<int>>,VertexColours:array<string>,EdgeColours:array<string>>>"
GRAPH_PATHWAY = f"file_graph {_DRAWN}, remnant {_DRAWN}, duplicates array<struct<Left:array<array<int>>,Right:array<array<int>>>>, removed_edges array<array<int>>"
STRING_CERTIFICATE = "accept_reversed boolean, input string, terminals array<struct<id:int,code_point:int>>, rules array<struct<id:int,left:int,right:int,length:int>>, residual array<struct<symbol:int,offset:int,length:int>>"
GRAPH_CERTIFICATE = "edges array<array<int>>, terminals array<struct<id:int,edges:array<int>>>, rules array<struct<id:int,left:int,right:int,edges:array<int>>>, residual array<struct<symbol:int,edges:array<int>>>"


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _canonical(text: Column, reverse: bool) -> Column:
    return F.least(text, F.reverse(text)) if reverse else text


def string_pathway(document: Column, reverse: bool = False) -> dict[str, Column]:
    """Joins that a string pathway costs, symbols that its pieces cover, and whether each duplicate's two places hold equal text apart."""
    d = F.from_json(document, STRING_PATHWAY)
    text, moves = d["file_graph"][0]["Fragments"][0], d["duplicates"]
    piece = lambda at: _canonical(F.substr(text, at[0] + 1, at[1]), reverse)
    return {
        "joins": F.length(text) - 1 - total(F.transform(moves, lambda m: m["Left"][1] - 1)),
        "symbols": total(F.transform(d["remnant"][0]["Fragments"], F.length)) + total(F.transform(moves, lambda m: m["Right"][1])),
        "sound": F.forall(moves, lambda m: (m["Left"][1] == m["Right"][1]) & (F.abs(m["Left"][0] - m["Right"][0]) >= m["Left"][1]) & (piece(m["Left"]) == piece(m["Right"]))),
    }


def graph_pathway(document: Column) -> dict[str, Column]:
    """Joins that a graph pathway costs (not compensated), edges that its pieces cover, and whether each duplicate has two disjoint sides of one size."""
    d = F.from_json(document, GRAPH_PATHWAY)
    moves = d["duplicates"]
    return {
        "joins": F.size(d["file_graph"][0]["Edges"]) - 1 - total(F.transform(moves, lambda m: F.size(m["Left"]) - 1)),
        "edges": F.size(d["remnant"][0]["Edges"]) + total(F.transform(moves, lambda m: F.size(m["Right"]))) + F.size(d["removed_edges"]),
        "sound": F.forall(moves, lambda m: (F.size(m["Left"]) == F.size(m["Right"])) & ~F.arrays_overlap(m["Left"], m["Right"])),
    }


def string_certificate(document: Column) -> dict[str, Column]:
    """Joins that a string certificate costs, symbols of its residual, and whether the residual tiles the input and each rule joins known symbols."""
    d = F.from_json(document, STRING_CERTIFICATE)
    rules, residual = d["rules"], d["residual"]
    known = F.concat(F.transform(d["terminals"], lambda t: F.struct(t["id"].alias("id"), F.lit(1).alias("length"))), F.transform(rules, lambda r: F.struct(r["id"].alias("id"), r["length"].alias("length"))))
    length = F.map_from_entries(known)
    ends = F.transform(residual, lambda r: r["offset"] + r["length"])
    starts = F.transform(residual, lambda r: r["offset"])
    return {
        "joins": F.size(rules) + F.size(residual) - 1,
        "symbols": total(F.transform(residual, lambda r: r["length"])),
        "sound": (F.concat(F.array(F.lit(0)), ends) == F.concat(starts, F.array(F.length(d["input"]))))
        & F.forall(residual, lambda r: length[r["symbol"]] == r["length"])
        & F.forall(rules, lambda r: (r["left"] < r["id"]) & (r["right"] < r["id"]) & (length[r["left"]] + length[r["right"]] == r["length"])),
    }


def graph_certificate(document: Column) -> dict[str, Column]:
    """Joins that a graph certificate costs (not compensated), edges of its residual, and whether the residual holds every edge once."""
    d = F.from_json(document, GRAPH_CERTIFICATE)
    held = F.flatten(F.transform(d["residual"], lambda r: r["edges"]))
    size = F.map_from_entries(F.transform(F.concat(F.transform(d["terminals"], lambda t: F.struct(t["id"].alias("id"), t["edges"].alias("edges"))), F.transform(d["rules"], lambda r: F.struct(r["id"].alias("id"), r["edges"].alias("edges")))), lambda s: F.struct(s["id"], F.size(s["edges"]))))
    return {
        "joins": F.size(d["rules"]) + F.size(d["residual"]) - 1,
        "edges": F.size(held),
        "sound": (F.array_sort(held) == F.sequence(F.lit(0), F.size(d["edges"]) - 1)) & F.forall(d["residual"], lambda r: size[r["symbol"]] == F.size(r["edges"])) & F.forall(d["rules"], lambda r: size[r["left"]] + size[r["right"]] == F.size(r["edges"])),
    }
