"""Column-returning helpers; everything here stays inside whole-stage codegen
except the statistics distribution functions (Arrow-batched pandas UDFs)."""
