"""Schemas that the operators share."""

from __future__ import annotations

FIX = "struct<start_offset:int,end_offset:int,replacement:string>"
#: One finding. ``phase``, ``rule_ord``, ``k1`` and ``k2`` give the contractual order within a file.
FINDING = f"file string, line int, rule string, severity string, message string, fix {FIX}, end_line int, phase int, rule_ord int, k1 int, k2 int"
#: One node of a tree with what its rules ask of its ancestors, so that no rule joins nodes to nodes: how many control
#: structures enclose it (itself included, else-ifs not), how many branches stand between it and its function, whether it
#: is an else-if, its nearest enclosing function (-1: none), its parent, and the line of its next sibling.
NODE = (
    "id string, node_id int, parent_id int, ord int, type string, line int, name string, kind string, n_children int, depth int, nest int, else_if boolean, owner int, "
    "parent_type string, parent_line int, parent_name string, parent_empty boolean, first_block boolean, next_line int"
)
SEVERITIES = ("error", "warning", "info")
