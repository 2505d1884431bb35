"""Declarations: edge, node, path, metapath and label specifications and their JSON forms."""
