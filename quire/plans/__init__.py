"""Plan helpers shared by operators: scratch tables that cut lineage, and checked broadcasts."""
