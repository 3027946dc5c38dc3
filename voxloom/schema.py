"""Schemas of the engine's tables. In all of them y is the vertical axis (image rows) and x the horizontal one."""

from __future__ import annotations

TILES = "acq_id string, channel int, row int, col int, path string, ftype string, frame_size int, n_planes int"
VOXELS = "row int, col int, z int, y int, x int, v int"
BLOCKS = "row int, col int, zb int, yb int, xb int, shape array<int>, dtype string, data binary"
PARTICLES = "row int, col int, parts_name string, is_leaf boolean, level int, z_l int, y_l int, x_l int, v double"
PROJECTIONS = "row int, col int, side string, plane string, h int, w int, data binary"
EDGES = "a int, b int, side string, d_h double, d_v double, d_d double, r_h double, r_v double, r_d double"
REGISTRATION = "path string, row int, col int, dH double, dV double, dD double, ABS_H double, ABS_V double, ABS_D double"
LABELS = "z int, y int, x int, label short"
CELLS = "cell_id long, z double, y double, x double"
ATLAS = "z int, y int, x int, id long"
ONTOLOGY = "id long, parent_id long, acronym string, name string, path array<long>"
