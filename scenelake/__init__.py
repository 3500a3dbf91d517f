"""DataFrame operators for scene data held as tables: rasters, masks, point clouds, meshes, run logs and jobs."""
