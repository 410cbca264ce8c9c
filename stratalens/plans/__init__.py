"""Query plans over the star-schema tables: operators applied to analogues of images."""
