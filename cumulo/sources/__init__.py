"""Readers and writers for meshes, points, manifests, result rows and logs."""
