"""quirel.functions"""
