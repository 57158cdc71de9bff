"""From positioned words to tables: words -> lines -> cells -> bands -> grids -> verdicts."""
