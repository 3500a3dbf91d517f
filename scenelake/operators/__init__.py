"""Operators: each takes DataFrames and returns a DataFrame over all images, scenes, meshes or jobs at once."""
