"""From a where-clause and name lists to one logical plan."""
