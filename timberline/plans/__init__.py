"""Control data and the engine that puts sources, filters and operators together."""
