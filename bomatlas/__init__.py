"""Dependency intelligence for software bills of materials, as Spark jobs."""
