"""litprops: Spark jobs over tables of material-property records mined from papers."""
