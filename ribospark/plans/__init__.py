"""Plan-level helpers shared by the operators: session set-up and lineage cuts."""
