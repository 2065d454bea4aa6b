"""geoflow: Spark jobs for point clouds, meshes and diffusion operators held in tables."""
