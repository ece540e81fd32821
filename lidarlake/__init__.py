"""LiDAR map analytics on Spark: scans, place recognition, registration, pose graphs, trajectories."""
