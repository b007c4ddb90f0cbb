"""Aggregates, solvers, maps, stencils and codecs as DataFrame transformations. What joins parameters back to rows runs
the job that makes the parameters, to know how many there are; all else is lazy."""
