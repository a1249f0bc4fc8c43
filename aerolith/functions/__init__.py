"""Column functions: parsing, circular and spherical geometry, quantiles, time, chemistry, weather, health."""
